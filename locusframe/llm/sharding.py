"""Sharding by jump consistent hashing, in DataFrame expressions only.

The law is ``key``: the document id and the number of shards decide. Going from n to n + 1 shards moves rows only into
the new shard, 1/(n + 1) of them on average, and no ring table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

#: Fixed value: the multiplier of the 64-bit linear congruential generator that jump consistent hashing steps through.
MULTIPLIER = 2862933555777941757
_LOW32, _LOW22 = 0xFFFFFFFF, (1 << 22) - 1


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, from products that stay under 2^63 (ANSI arithmetic refuses to wrap)."""
    high, low = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & _LOW32)
    k0 = key.bitwiseAND(F.lit(_LOW22))
    k1 = F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_LOW22))
    k2 = F.shiftrightunsigned(key, 44)
    # low half of the multiplier times the key, in two 32-bit halves
    p0, p1, p2 = k0 * low, k1 * low, k2 * low  # each under 2^54, to be shifted by 0, 22 and 44 bits
    low_half = p0.bitwiseAND(F.lit(_LOW32)) + F.shiftleft(p1.bitwiseAND(F.lit((1 << 10) - 1)), 22) + F.lit(1)
    carry = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 10) + F.shiftleft(p2.bitwiseAND(F.lit((1 << 20) - 1)), 12) + F.shiftrightunsigned(low_half, 32)
    cross = (key.bitwiseAND(F.lit((1 << 16) - 1)) * high) + F.shiftleft((F.shiftrightunsigned(key, 16).bitwiseAND(F.lit((1 << 16) - 1)) * high).bitwiseAND(F.lit((1 << 16) - 1)), 16)
    top = (carry.bitwiseAND(F.lit(_LOW32)) + cross.bitwiseAND(F.lit(_LOW32))).bitwiseAND(F.lit(_LOW32))
    return F.shiftleft(top, 32).bitwiseOR(low_half.bitwiseAND(F.lit(_LOW32)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key. A key takes at most ``shards`` jumps, about log(shards) on average."""

    def step(state: Column, _: Column) -> Column:
        after = _next_state(state["key"])
        jump = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(after, 33) + F.lit(1)).cast("double")))
        return F.when(state["j"] >= F.lit(shards), state).otherwise(F.struct(after.alias("key"), state["j"].alias("b"), jump.alias("j")))

    start = F.struct(key.cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.when(s["j"] < F.lit(shards), s["j"]).otherwise(s["b"]).cast("int"))


def shard(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", pieces: int = 1024, most: int = 4096) -> DataFrame:
    """Assign every row to a shard and give it a gapless slot there.

    Slots: rows that agree in all that is returned are counted, map-side first, and stand in lots of ``most`` at most;
    each shard is cut into ``pieces`` by a hash of the lots; lots are numbered by id, then text, within a piece; the
    pieces' row counts, at most shards * pieces of them, give where each piece begins. No shard is ever sorted as a whole,
    and a row that is repeated without end is many lots in many pieces.
    A null id has a shard like any other value; a null text has no bytes; equal rows get slots of their own, in any order;
    texts of any length are hashed whole; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    src = pick(df, key, text).toDF("k", "t")
    rows = src.select(
        "k",
        (F.coalesce(F.octet_length("t"), F.lit(0)) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("t"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    equal = rows.groupBy("k", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - F.lit(1)) / F.lit(most)))))
    lots = lots.select(
        "k", "size", "text_crc32", "lot",
        F.least(F.lit(most).cast("bigint"), F.col("copies") - F.col("lot") * F.lit(most)).alias("n"),
        jump_hash(F.xxhash64("k"), shards).alias("shard"),
        jump_hash(F.xxhash64("k"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("k", "text_crc32", "size", "lot", F.lit("piece")), F.lit(pieces)).cast("int").alias("piece"),
    )
    counts = lots.groupBy("shard", "piece").agg(F.sum("n").alias("n"))
    # at most shards * pieces rows, whatever the input; one small list per shard turned into running sums
    begins = (
        counts.groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("piece", "n"))).alias("l"))
        .select("shard", F.expr("inline(transform(l, (x, i) -> struct(x.piece as piece, aggregate(slice(l, 1, i), 0L, (a, y) -> a + y.n) as begin)))"))
    )
    order = Window.partitionBy("shard", "piece").orderBy(F.col("k").asc_nulls_first(), "text_crc32", "size", "lot")
    placed = lots.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    out = placed.join(F.broadcast(begins), ["shard", "piece"])
    first = F.col("begin") + F.col("before")
    return out.select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast(T.IntegerType()),
        F.explode(F.sequence(first, first + F.col("n") - F.lit(1))).alias("slot"), F.col("grown_shard").cast(T.IntegerType()),
    )
