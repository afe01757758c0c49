"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of 16 segments of 4 bits. If two fingerprints differ in at most 3 bits, then from some segment on
every chain of l consecutive segments differs in at most 3 l / 16 bits: in no bit up to l = 5, in at most 1 up to l = 10,
in at most 2 up to l = 15. The first 20 bits of that chain are equal, and so is one half of the next 20: these 30 bits,
for each start and half, are the join key. Pairs that meet must pass the chain budgets before the full Hamming check.

A bucket gives the links of a spanning forest, never all pairs. Buckets over BLOCK fingerprints are cut into blocks and
each pair of blocks is a group of its own, so that no group is unbounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, map_batches, materialize, pick

#: Lower-cases A-Z in UTF-8 bytes.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A bucket of more distinct fingerprints than this is cut into blocks of about half of it.
BLOCK = 32_768
#: Hot buckets are joined by broadcast up to this number of them (16 bytes each), by a shuffle beyond.
FEW = 100_000
#: Likewise (id, fingerprint) of the rows that go, when whole rows are filtered, up to this number and these bytes: beyond,
#: these are shuffled.
FEW_GONE, FEW_BYTES = 500_000, 16 << 20


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()  # splits at 0x20, 0x09-0x0D only
    if not words:
        return 0
    joined, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(lens + 1) - 1
        starts = ends - lens
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        counts += np.unpackbits(h[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of each row. Null and empty texts have fingerprint zero."""
    src = pick(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return map_batches(src, run, f"`{key}` {src.schema[0].dataType.simpleString()}, fp bigint")


def _rotated(fp: Column, bits: int) -> Column:
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _keys(fp: Column) -> Column:
    """The 32 join keys: start of the chain (4 bits), half (1 bit), the chain's first 20 bits and 10 of the next 20."""
    out = []
    for i in range(16):
        r = _rotated(fp, 4 * i)
        head = F.shiftleft(F.shiftrightunsigned(r, 44), 10)
        for half, shift in ((0, 34), (1, 24)):
            tail = F.shiftrightunsigned(r, shift).bitwiseAND(F.lit(1023))
            out.append(head.bitwiseOR(tail).bitwiseOR(F.lit((2 * i + half) << 30)))
    return F.array(*out)


def _near(x: np.ndarray) -> np.ndarray:
    """Of differences rotated to the start of the chain: within every budget of the chain, then within 3 bits in all."""
    ok = np.bitwise_count(x >> np.uint64(24)) <= 1
    ok &= np.bitwise_count(x >> np.uint64(4)) <= 2
    return ok & (np.bitwise_count(x) <= 3)


def _forest(r: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (positions) of a spanning forest of one bucket: each found member is compared with those not yet found."""
    left, out = np.arange(len(r)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = _near(r[left] ^ r[u])
            if hit.any():
                found = left[hit]
                out.append((np.full(len(found), u), found))
                queue.extend(found.tolist())
                left = left[~hit]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, p, q, fp), sorted by the first three: links of each group of equal (key, p, q)."""

    def links(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, p, q, fp = cols
        if len(fp) < 2:
            return
        turn = (((key >> 31) & 15) * 4).astype(np.uint64)
        u = fp.view(np.uint64)
        r = np.where(turn == 0, u, (u << turn) | (u >> ((np.uint64(64) - turn) & np.uint64(63))))
        new = np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(fp)])
        group = np.cumsum(new) - 1
        small = sizes <= 64
        a, b = [], []
        for d in range(1, int(sizes[small].max(initial=1))):
            if d >= len(fp):
                break
            at = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
            if not len(at):
                break
            at = at[_near(r[at] ^ r[at + d])]
            a.append(at)
            b.append(at + d)
        for g in np.flatnonzero(~small).tolist():
            s = starts[g]
            for x, y in _forest(r[s : s + sizes[g]]):
                a.append(x + s)
                b.append(y + s)
        if a and len(x := np.concatenate(a)):
            x, y = fp[x], fp[np.concatenate(b)]
            pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def gathered() -> Iterator[list[np.ndarray]]:
        """Columns of at least 50,000 rows together."""
        some: list[list[np.ndarray]] = []
        for batch in batches:
            some.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in some) >= 50_000:
                yield [np.concatenate(x) for x in zip(*some, strict=True)]
                some = []
        if any(len(x[0]) for x in some):
            yield [np.concatenate(x) for x in zip(*some, strict=True)]

    held: list[np.ndarray] | None = None
    for cols in gathered():
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = len(last) - int(last.sum())
        held = [c[cut:] for c in cols]
        if cut:
            yield from links([c[:cut] for c in cols])
    if held is not None:
        yield from links(held)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a > b: links that join all fingerprints of column fp (distinct) within 3 bits into their components."""
    keys = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    hot, hot_path = materialize(keys.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") * 2 / F.lit(block)).cast("int").alias("n")), "simhash-hot")
    number = hot.count()
    if number == 0:
        dealt = keys.select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), "fp")
        delete(fps.sparkSession, hot_path)
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = (
            keys.join(F.broadcast(hot) if number <= FEW else hot, "key", "left")
            .withColumn("mine", F.when(F.col("n").isNotNull(), mine))
            .withColumn("other", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda x: x != F.col("mine")))))
            .select("key", F.when(F.col("other") < 0, 0).otherwise(F.least("mine", "other")).alias("p"), F.when(F.col("other") < 0, 0).otherwise(F.greatest("mine", "other")).alias("q"), "fp")
        )
    grouped = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return grouped.mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every node of edges (a, b), root its component's least node: large and small stars in turn, until
    a round changes nothing and every node hangs on one root (log of the nodes, squared, in rounds at most)."""
    spark = edges.sparkSession
    now, path = materialize(edges, "simhash-links")
    state = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(low.select("a", F.col("m").alias("b"))).distinct()
        after, after_path = materialize(small, "simhash-stars")
        delete(spark, path)
        now, path = after, after_path
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        if state == seen and seen[0] == seen[2]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")), path
        state = seen


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): the least key reachable over links of at most 3 differing bits, for every row.

    Texts without words share fingerprint zero and are linked like any other; repeated rows share a component; null keys
    get a component but are never its name unless it has no other; an empty table gives none. Other columns are ignored.
    """
    all_fps, _ = materialize(fingerprints(df, key, text).withColumnRenamed(key, "k"), "simhash-fps")
    nodes = all_fps.groupBy("fp").agg(F.min("k").alias("first"))
    roots, _ = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return all_fps.join(named, "fp").select(F.col("k").alias(key), "fp", "component_id")


def _small(rows: DataFrame) -> tuple[int, bool]:
    """How many rows (k, fp) there are, and whether number and bytes allow a broadcast."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("k").cast("string")) + F.lit(16)), F.lit(0))).first()
    return n, n <= FEW_GONE and size <= FEW_BYTES


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows of docs, one for each group of near-duplicates: that with the least key, one of those that repeat it.

    All columns stay as they are, whatever their names. Null and empty texts are near-duplicates of each other, so that one
    of them stays; of rows that repeat the least key and its text any one; a null key stays only where its group has no
    other; texts of any length are read whole; an empty table stays empty.
    """
    found, _ = materialize(near_duplicates(docs, key, text).withColumnRenamed(key, "k"), "simhash-found")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("fp").alias("f"))).alias("s"))
    own = found.alias("d").join(first.alias("r"), F.col("d.component_id").eqNullSafe(F.col("r.component_id")))
    stays = F.col("d.k").eqNullSafe(F.col("r.s.k")) & (F.col("d.fp") == F.col("r.s.f"))
    gone, _ = materialize(own.where(~stays).select("d.k", "d.fp").distinct(), "simhash-gone")
    few = _small(gone)[1]
    repeated, _ = materialize(found.groupBy("k", "fp").count().where("count > 1").select("k", "fp"), "simhash-repeated")
    n_repeated, few_repeated = _small(repeated)
    names = docs.columns
    at_key, at_text = names.index(key), names.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t) for t in b.column(at_text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], [*b.schema.names, "fp"])

    from pyspark.sql import types as T

    marked = map_batches(plain, run, T.StructType([*plain.schema.fields, T.StructField("fp", T.LongType())]))
    same = lambda t: marked[f"c{at_key}"].eqNullSafe(t["k"]) & (marked["fp"] == t["fp"])
    kept = marked.join(F.broadcast(gone) if few else gone, same(gone), "left_anti")
    if n_repeated:  # one of the rows that share both id and fingerprint
        twice = F.broadcast(repeated) if few_repeated else repeated
        once = kept.join(twice, same(repeated), "left_anti")
        kept = once.unionByName(kept.join(twice, same(repeated), "left_semi").dropDuplicates([f"c{at_key}", "fp"]))
    return kept.drop("fp").toDF(*names)


def contract(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
