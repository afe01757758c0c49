"""Blocks and digests against a walk over the rows, and hashlib."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import blocks, integrity


def walked(rows, n_variants, n_bases):
    """Blocks of (contig, pos) rows in order, one row after another: lists of row numbers."""
    out = []
    for i, (contig, pos) in enumerate(rows):
        first = rows[out[-1][0]] if out else None
        if first is None or contig != first[0] or pos - first[1] > n_bases or len(out[-1]) >= n_variants:
            out.append([])
        out[-1].append(i)
    return out


def table(spark, n, seed, ties=0.2):
    r = random.Random(seed)
    rows, pos = [], 0
    for i in range(n):
        pos += 0 if r.random() < ties else r.choice([1, 1, 2, 50, 3000])
        if r.random() < 0.002:
            pos = 1
        rows.append((f"c{1 + i * 4 // n}", pos, f"id{i}", ["A", "C"]))
    return sorted(rows, key=lambda x: (x[0], x[1])), "contig string, pos bigint, id string, alleles array<string>"


def expected(rows, n_variants, n_bases):
    number, out = {}, []
    for seq, own in enumerate(walked([r[:2] for r in rows], n_variants, n_bases)):
        contig = rows[own[0]][0]
        number[contig] = number.get(contig, -1) + 1
        first = next(i for i, r in enumerate(rows) if r[:2] == rows[own[0]][:2])
        last = next(i for i, r in enumerate(rows) if r[:2] == rows[own[-1]][:2])
        out.append((seq, contig, f"{contig}:{number[contig]}", len(own), rows[own[0]][1], rows[own[-1]][1], own[0] - first, own[-1] - last))
    return out


@pytest.mark.parametrize(("n", "n_variants", "n_bases", "chunk"), [(2500, 7, 100, 28), (2500, 3, 10**9, 12), (900, 1000, 60, 64), (700, 1, 10**6, 4), (500, 50, 0, 200), (40, 1000, 10**7, 1 << 16)])
def test_index_is_that_of_a_walk(spark, n, n_variants, n_bases, chunk):
    rows, kind = table(spark, n, n)
    df = spark.createDataFrame(rows, kind).repartition(5)
    got = blocks.block_index(df, n_variants, n_bases, chunk).orderBy("seq")
    assert [tuple(r) for r in got.collect()] == expected(rows, n_variants, n_bases)


def test_chunks_are_composed_over_many_levels(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 3)
    rows, kind = table(spark, 1200, 5)
    got = blocks.block_index(spark.createDataFrame(rows, kind), 4, 200, 16).orderBy("seq")
    assert [tuple(r) for r in got.collect()] == expected(rows, 4, 200)


def test_a_position_of_many_rows(spark):
    rows = [("c1", 5, f"id{i}", ["A"]) for i in range(300)] + [("c1", 6, "z", ["A"]), ("c2", 1, "y", ["A"])]
    df = spark.createDataFrame(rows, "contig string, pos bigint, id string, alleles array<string>").repartition(4)
    index = blocks.block_index(df, 70, 10, 280)
    assert sorted(tuple(r) for r in index.collect()) == expected(rows, 70, 10)
    got = blocks.blocks(df, 70, 10)
    assert got.count() == 302 and sorted(r["count"] for r in got.groupBy("block_id").count().collect()) == [1, 21, 70, 70, 70, 70]
    assert got.select("id").distinct().count() == 302
    same = {r.id for r in got.where("block_id = 'c1:2'").collect()}
    assert {r.id for r in blocks.read_block(df, "c1:2", 70, 10).collect()} == same and len(same) == 70


@pytest.mark.parametrize("most", [10**6, 0])
def test_rows_and_single_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(blocks, "BROADCAST", most)
    rows, kind = table(spark, 1500, 11, ties=0.05)
    df = spark.createDataFrame(rows, kind).repartition(6)
    index = blocks.block_index(df, 20, 5000).cache()
    got = blocks.blocks(df, 20, 5000, index)
    sizes = {r.block_id: r.n_variants for r in index.collect()}
    assert {r.block_id: r["count"] for r in got.groupBy("block_id").count().collect()} == sizes and got.select("id").distinct().count() == 1500
    straight = got.join(index.withColumnRenamed("block_id", "b"), F.col("block_id") == F.col("b")).where("pos < min_pos or pos > max_pos")
    assert straight.isEmpty()
    one = sorted(sizes)[7]
    assert sorted(r.id for r in blocks.read_block(df, one, index=index).collect()) == sorted(r.id for r in got.where(F.col("block_id") == one).collect())
    with pytest.raises(ValueError, match="no such block"):
        blocks.read_block(df, "c9:0", index=index)


def test_no_rows(spark):
    df = spark.createDataFrame([], "contig string, pos bigint, id string, alleles array<string>")
    assert blocks.block_index(df).isEmpty() and blocks.blocks(df).isEmpty()


def tree_of(leaves, fan, bits):
    levels = [leaves]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([hashlib.new(bits, "\n".join(own[i : i + fan]).encode()).hexdigest() for i in range(0, len(own), fan)])
    return levels


def test_digest_trees(spark):
    rows, kind = table(spark, 800, 3, ties=0)
    df = spark.createDataFrame(rows, kind).repartition(3)
    own = walked([r[:2] for r in rows], 9, 500)
    for bits in (256, 512):
        leaves = [hashlib.new(f"sha{bits}", "\n".join(rows[i][2] for i in b).encode()).hexdigest() for b in own]
        levels = tree_of(leaves, 4, f"sha{bits}")
        got = integrity.block_digest(df, ["id", "pos"], bits, n_variants=9, n_bases=500)
        assert [r[f"sha{bits}"] for r in got.where("column = 'id'").orderBy("seq").collect()] == leaves
        tree = integrity.digest_tree(df, ["id", "pos"], bits, 4, n_variants=9, n_bases=500)
        found = {(r.level, r.node): r.digest for r in tree.where("column = 'id'").collect()}
        assert found == {(i, k): d for i, level in enumerate(levels) for k, d in enumerate(level)} and len(levels) > 3
        root = {r.column: (r.n_blocks, r[f"sha{bits}"]) for r in integrity.column_digests(df, ["id", "pos"], bits, 4, n_variants=9, n_bases=500).collect()}
        assert root["id"] == (len(own), levels[-1][0])
    for seq in (0, 5, len(own) - 1):
        proof = integrity.digest_proof(tree, "id", seq, 4)
        assert len(proof) == len(levels) - 1 and all(len(x) <= 4 for _, x in proof)
        assert integrity.proves(proof, leaves[seq], levels[-1][0]) and not integrity.proves(proof, leaves[seq - 1], levels[-1][0])
        assert not integrity.proves(proof, leaves[seq], leaves[seq])
    other = df.withColumn("id", F.when(F.col("id") == rows[400][2], "changed").otherwise(F.col("id")))
    seq = next(i for i, b in enumerate(own) if 400 in b)
    changed = integrity.changed_blocks(tree, integrity.digest_tree(other, ["id", "pos"], 512, 4, n_variants=9, n_bases=500), 4)
    assert [tuple(r) for r in changed.collect()] == [("id", seq)] and integrity.changed_blocks(tree, tree, 4).isEmpty()
    assert integrity.column_sha512(df.limit(3), ["id"]).first().n_blocks == 1
    assert integrity.column_digests(df.limit(0), ["id"]).isEmpty()
