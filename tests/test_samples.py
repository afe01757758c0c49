"""Statistics by sample against a walk over all calls, and the shape of their plan."""

import json
import random
from collections import Counter

from locusframe.operators import samples

BASES = {"A": 0, "T": 1, "G": 2, "C": 3}


def classes(alleles):
    ref = alleles[0]
    if len(ref) == 1 and ref not in BASES:
        return None
    out = [(BASES[ref] if len(ref) == 1 else 4, 0)]
    for x in alleles[1:]:
        plain, more = x != "" and set(x) <= set("ATGC"), len(x) - len(ref)
        if len(ref) == 1 == len(x):
            out.append((BASES.get(x, 4), 0))
        elif plain and more > 0:
            out.append((7, min(255, more)))
        elif plain and more < 0 and len(ref) > 1:
            out.append((8, max(-255, more)))
        else:
            out.append((4, 0))
    return out


def walked(sites):
    conv, sizes, single = Counter(), Counter(), Counter()
    for alleles, gt in sites:
        cl = classes(alleles)
        if cl is None or gt is None:
            continue
        ploidy = max((len(a) for a in gt), default=0)
        carriers = [i for i, a in enumerate(gt) for x in a if x > 0]
        if len(carriers) == 1:
            single[carriers[0]] += 1
        for i, a in enumerate(gt):
            if not any(x != 0 for x in a):
                continue
            for x in [*a, *[-2] * (ploidy - len(a))]:
                code, size = (5, 0) if x == -1 else (6, 0) if x == -2 else cl[x] if x < len(cl) else (4, 0)
                conv[i, cl[0][0], code] += 1
                if code in (7, 8):
                    sizes[i, 2 * size if size >= 0 else -2 * size - 1] += 1
    return conv, sizes, single


def sites(n=300, n_samples=9, seed=3):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ref = r.choice(["A", "C", "G", "T", "N", "ACG", "ACGTACGTAC" * 30])
        alts = r.sample(["A", "C", "G", "T", "AC", "A" * 400, "<DEL>", "*", "ACG", "CC"], r.randrange(1, 4))
        ploidy = r.choice([1, 2, 2, 2, 3])
        gt = [[r.choice([-1, 0, 0, 0, 0, 1, 1, 2, 7]) for _ in range(r.choice([ploidy, ploidy, r.randrange(1, ploidy + 1)]) if k % 3 == 0 else ploidy)] for _ in range(n_samples)]
        if k % 11 == 0:
            gt = [[0] * ploidy] * 4 + [[0, 1][: max(2, ploidy)]] + [[0] * ploidy] * (n_samples - 5)
        out.append(([ref, *[a for a in alts if a != ref]], None if k % 50 == 7 else gt))
    return [*out, (["A", "C"], [])]


def frame(spark, rows):
    return spark.createDataFrame([(a, None if g is None else [(x, [False] * len(x)) for x in g]) for a, g in rows], "alleles array<string>, gt array<struct<a:array<int>,p:array<boolean>>>").repartition(3)


def test_counts_are_those_of_a_walk(spark, monkeypatch):
    rows = sites()
    df = frame(spark, rows)
    conv, sizes, single = walked(rows)
    for held in (samples.HELD, 5):
        monkeypatch.setattr(samples, "HELD", held)
        assert {(r.sample_id, r.ref, r.code): r.n for r in samples.conversions(df).collect()} == conv
        assert {(r.sample_id, r.slot): r.n for r in samples.indel_spectrum(df).collect()} == sizes and sizes
        assert {r.sample_id: r.n_singleton for r in samples.singletons(df).collect()} == single and single


def test_a_row_for_each_sample(spark):
    rows = sites()
    names = [f"n{i}" for i in range(11)]  # two have no calls
    df = frame(spark, rows)
    conv, sizes, single = walked(rows)
    got = {r.name: r for r in samples.sample_rows(df, names).collect()}
    assert list(sorted(got)) == sorted(names)
    for i, name in enumerate(names):
        r = got[name]
        assert r.conv == [[conv[i, a, b] for b in range(9)] for a in range(9)]
        assert r.in_dist == [sizes[i, 2 * k] for k in range(1, 256)] and r.del_dist == [sizes[i, 2 * k - 1] for k in range(1, 256)]
        assert r.n_singleton == single[i] and r.n_ins == sum(conv[i, a, 7] for a in range(9)) and r.n_del == sum(conv[i, a, 8] for a in range(9))
        ts = sum(conv[i, a, b] for a, b in ((0, 2), (2, 0), (1, 3), (3, 1)))
        tv = sum(conv[i, a, b] for a in range(4) for b in range(4) if a != b) - ts
        assert (r.n_ts, r.n_tv, r.ts_tv) == (ts, tv, ts / tv if tv else 0.0)
    lines = [json.loads(r.value) for r in samples.json_lines(df, names).collect()]
    whole = json.loads(samples.to_json(df, names).first().value)
    assert [x for x in lines if "VI" in x] == [{"VI": whole["VI"]}]
    assert {x.pop("sample"): x for x in lines if "sample" in x} == whole["PSI"]


def test_one_scan_and_one_exchange(spark, tmp_path):
    frame(spark, sites(40)).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    for made in (samples.sample_summary(df), samples.conversions(df), samples.sample_cells(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1, plan
    plan = samples.sample_rows(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    assert samples.sample_cells(df.limit(0)).isEmpty()
