"""Special functions against Python's own and against exact sums, whose terms are added with math.fsum."""

import math

from pyspark.sql import functions as F

from locusframe.functions import special as S


def test_log_gamma_and_erfc(spark):
    values = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.0, 10.5, 100.0, 1e3, 1e6, 1e9]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.log_gamma("x").alias("v")).collect()
    assert all(math.isclose(r.v, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-13) for r in got)
    values = [-6.0, -2.5, -1.0, -0.1, 0.0, 1e-3, 0.3, 0.9, 1.0, 1.3, 2.0, 3.5, 6.0, 12.0, 25.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.erfc("x").alias("v")).collect()
    assert [(r.x, r.v) for r in got if not math.isclose(r.v, math.erfc(r.x), rel_tol=1e-10)] == []


def poisson_tails(a, x):
    """Of a or more events, and of fewer."""
    lower = math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(a))
    upper = math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(a, a + 4000))
    return upper, lower


def test_incomplete_gamma(spark):
    rows = [(a, x) for a in (1, 2, 5, 30, 400, 2500) for x in (0.01, 0.8, 1.0, 4.0, 29.0, 33.0, 380.0, 420.0, 2500.0)]
    got = spark.createDataFrame(rows, "a int, x double").select("a", "x", S.gamma_p("a", "x").alias("p"), S.gamma_q("a", "x").alias("q"), S.chi_square_tail(F.col("x") * 2, F.col("a") * 2).alias("c")).collect()
    for r in got:
        p, q = poisson_tails(r.a, r.x)
        assert math.isclose(r.p, p, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r.q, q, rel_tol=1e-9, abs_tol=1e-12) and r.c == r.q, r
    assert max(abs(r.p + r.q - 1) for r in got) < 1e-12


def test_incomplete_beta(spark):
    rows = [(k, n, p) for n in (1, 3, 20, 333, 5000) for k in {1, (n + 1) // 3 or 1, n // 2 or 1, n} for p in (0.001, 0.2, 0.5, 0.77, 0.999)]
    got = spark.createDataFrame(rows, "k int, n int, p double").select("k", "n", "p", S.beta_i("k", F.col("n") - F.col("k") + 1, "p").alias("v"), S.log_choose("n", "k").alias("c")).collect()
    for r in got:
        tail = math.fsum(math.exp(math.log(math.comb(r.n, j)) + j * math.log(r.p) + (r.n - j) * math.log1p(-r.p)) for j in range(r.k, r.n + 1))
        assert math.isclose(r.v, tail, rel_tol=1e-9, abs_tol=1e-11), r
        assert math.isclose(r.c, math.log(math.comb(r.n, r.k)), rel_tol=1e-11, abs_tol=1e-10), r


def test_borders_and_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (-1.0, 1.0), (2.0, None), (2.0, -1.0), (2.0, 0.0)], "a double, x double")
    got = df.select(S.gamma_p("a", "x").alias("p"), S.beta_i("a", F.lit(2), "x").alias("b"), S.log_gamma("a").alias("g"), S.erfc("x").alias("e")).collect()
    assert [r.p for r in got] == [None, None, None, None, None, 0.0]
    assert [r.b for r in got] == [None, None, None, None, None, 0.0]
    assert [r.g for r in got[:3]] == [None, None, None] and got[3].e is None and got[5].e == 1.0
    assert df.select(S.beta_i(F.lit(2), F.lit(3), F.lit(1)).alias("v")).first().v == 1.0
    plan = df.select(S.beta_i("a", F.lit(2), "x"))._jdf.queryExecution().toString()
    assert "Python" not in plan
