import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import exact, text


def hwe_brute(het, hom1, hom2):
    n, rare = het + hom1 + hom2, 2 * min(hom1, hom2) + het
    if n == 0:
        return 1.0
    p = {}
    for h in range(rare % 2, rare + 1, 2):
        r = (rare - h) // 2
        p[h] = 2**h * math.factorial(n) // (math.factorial(h) * math.factorial(r) * math.factorial(n - h - r))
    return sum(v for v in p.values() if v <= p[het]) / sum(p.values())


def fisher_brute(a, b, c, d):
    r, s, n = a + b, a + c, a + b + c + d
    p = {x: math.comb(s, x) * math.comb(n - s, r - x) for x in range(max(0, r + s - n), min(r, s) + 1)}
    return sum(v for v in p.values() if v <= p[a]) / sum(p.values())


def test_documented_values():
    assert round(exact.hwe_value(6, 15, 2), 7) == 0.2507196
    assert round(exact.hwe_value(57, 14, 50), 5) == 0.84228
    assert exact.hwe_value(0, 0, 0) == exact.hwe_value(1, 0, 0) == 1
    assert round(exact.fisher_value(21, 15, 2, 8), 7) == 0.0706460


def test_exact_tests_against_enumeration(spark):
    random.seed(1)
    rows = [(a, b, c, d) for a, b, c, d in itertools.product(range(4), repeat=4)] + [tuple(random.randrange(60) for _ in range(4)) for _ in range(100)]
    got = spark.createDataFrame(rows, "a int, b int, c int, d int").select("*", exact.hwe("a", "b", "c").alias("h"), exact.hwe("a", "c", "b").alias("h2"), exact.fisher("a", "b", "c", "d").alias("f"), exact.fisher("c", "d", "a", "b").alias("f2")).collect()
    for r in got:
        assert r.h == pytest.approx(hwe_brute(r.a, r.b, r.c), abs=1e-9) == exact.hwe_value(r.a, r.b, r.c)
        assert r.h2 == pytest.approx(r.h, abs=1e-12)
        assert r.f == pytest.approx(fisher_brute(r.a, r.b, r.c, r.d), abs=1e-9) == exact.fisher_value(r.a, r.b, r.c, r.d)
        assert r.f2 == pytest.approx(r.f, abs=1e-9)


def test_large_counts_do_not_overflow(spark):
    r = spark.createDataFrame([(0, 3000, 3000)], "a int, b int, c int").select(exact.hwe("a", "b", "c").alias("h"), exact.fisher(F.lit(4000), F.lit(0), F.lit(0), F.lit(4000)).alias("f")).first()
    assert r.h == pytest.approx(0, abs=1e-12) and r.f == pytest.approx(0, abs=1e-12)


def test_g_format():
    assert [exact.g_format(x) for x in (0.5, 525.07, 1e-7, 1234567.0, None, float("nan"), 100.0)] == ["0.5", "525.07", "1e-07", "1.23457e+06", ".", ".", "100"]


def test_text_helpers(spark):
    d = spark.createDataFrame([("a;;b;",), ("",), ("x  y\t z ",), ("p:q:r",)], "s string")
    rows = d.select(text.split_tokens(F.col("s"), ";").alias("t"), text.split_last(F.col("s"), ":").alias("l"), text.remove_whitespace(F.col("s")).alias("r"), text.squeeze_whitespace(F.col("s")).alias("q")).collect()
    assert rows[0].t == ["a", "b"] and rows[1].t == [] and rows[3].l == ["p:q", "r"] and rows[0].l == ["a;;b;", ""]
    assert rows[2].r == "xyz" and rows[2].q == "x y z"


def test_stats_json_names_every_sample(spark):
    import json

    from locusframe.operators import samples

    df = spark.createDataFrame([(["A", "G"], [([0, 1], [True]), ([0, 0], [True])])], "alleles array<string>, gt array<struct<a:array<int>,p:array<boolean>>>")
    got = json.loads(samples.to_json(df, ["a", "b"]).first().value)
    assert got["VI"]["n_samples"] == 2 and list(got["PSI"]) == ["a", "b"] and got["PSI"]["a"]["n_ts"] == 1
    b = got["PSI"]["b"]
    assert [b[c] for c in ("n_ts", "n_tv", "ts_tv", "n_ins", "n_del", "n_singleton")] == [0] * 6 and b["conv"] == [[0] * 9] * 9 and b["in_dist"] == b["del_dist"] == [0] * 255
