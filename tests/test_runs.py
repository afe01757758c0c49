"""Annotations counted from runs against those counted from calls."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import annotate, runs
from locusframe.plans.query import VariantQuery
from locusframe.sources import store
from locusframe.sources.header import Header

KIND = "contig string, pos bigint, alleles array<string>, gt array<struct<a:array<int>,p:array<boolean>>>"


def frame(spark, n=60, samples=23, seed=5):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        ploidy = r.choice([1, 2, 2, 2, 3])
        gt = []
        while len(gt) < samples:
            size = ploidy if k % 4 else r.randrange(1, ploidy + 1)
            gt += [([r.choice([-1, 0, 0, 0, 1, 1, 2]) for _ in range(size)], [False] + [r.random() < 0.5] * (size - 1))] * r.choice([1, 1, 4, 9])
        rows.append(("c1", k + 1, ["A", "C", "G"] if k % 3 else ["A", "T"], None if k == 7 else [] if k == 8 else gt[:samples]))
    return spark.createDataFrame(rows, KIND).repartition(3)


def test_runs_round_trip(spark):
    df = frame(spark)
    packed = df.withColumn("r", runs.pack())
    back = packed.withColumn("b", runs.expand("r"))
    assert back.where(~F.col("b").eqNullSafe(F.col("gt"))).isEmpty()
    for row in packed.collect():
        ends, own = [x.e for x in row.r or []], [(x.a, x.p) for x in row.r or []]
        assert ends == sorted(set(ends)) and (not ends or ends[-1] == len(row.gt)) and all(x != y for x, y in zip(own, own[1:]))


def test_annotations_from_runs(spark):
    df = frame(spark)
    packed = runs.with_runs(df)
    groups = {"g": [0, 1, 2, 7, 22], "h": list(range(5, 20)), "none": [], "twice": [3, 4, 5]}
    rows = lambda d: sorted(map(repr, d.drop("gt", "gt_runs").collect()))
    for naming in ("code", "docs"):
        assert rows(annotate.annotate(df, naming=naming)) == rows(annotate.annotate(packed, naming=naming))
    assert rows(annotate.annotate_groups(df, groups)) == rows(annotate.annotate_groups(packed, groups))
    got, want = (sorted(annotate.f_statistics(d, groups, None).select("pos", "FIS", "FST", "FIT").collect()) for d in (packed, df))
    assert [r.pos for r in got] == [r.pos for r in want] and any(r.FIS is not None for r in got)
    assert all(x == pytest.approx(y, abs=1e-12) for g, w in zip(got, want) for x, y in zip(g[1:], w[1:], strict=True) if y is not None or x is not None)


def test_a_store_of_runs(spark, tmp_path):
    df = frame(spark, 200, 400)
    header = Header.parse(["##fileformat=VCFv4.2", "##contig=<ID=c1,length=1000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i}" for i in range(400))])
    store.write_store(df, header, str(tmp_path / "runs"), runs=True)
    q = VariantQuery.open(spark, str(tmp_path / "runs"))
    assert q.df.select(*df.columns).exceptAll(df).isEmpty() and q.df.count() == df.count()
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    counted = annotate.annotate(q.df, ["AC", "HWE_P"], into=None).select("pos", "AC", "HWE_P")
    assert "array_repeat" not in plan(counted) and "array_repeat" in plan(q.df.select("gt"))
    few = q.samples("s3", "s1")
    assert "gt_runs" not in few.df.columns and "gt_runs" not in q.sites().df.columns
    want = annotate.annotate(df.withColumn("gt", F.when(F.col("gt").isNotNull(), F.array(F.get("gt", F.lit(3)), F.get("gt", F.lit(1))))), ["AC"], into=None).select("pos", "AC")
    assert sorted(annotate.annotate(few.df, ["AC"], into=None).select("pos", "AC").collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="runs"):
        store.write_store(df, header, str(tmp_path / "x"), keys={"gt": bytes(32)}, runs=True)
