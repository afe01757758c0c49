"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

A source's documents lie, in a seeded order, on shards of bounded size, and each shard is cut into blocks of equal
length. Sources get blocks by highest quotients target / (2k + 1): all quotients that reach half a block, which is the
Sainte-Laguë seating of the house that results. A source's blocks go to its shards by highest quotients as well, and a
shard takes its quota from its blocks in seeded order, all of them before any is taken again. Only (source, id, size)
is shuffled, never a text.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, materialize, pick

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; words and lots of a shard that a source is dealt to; shards of one source at most.
BLOCK, SHARD_WORDS, SHARD_LOTS, SHARDS = 32, 1 << 16, 4096, 4096
#: Rows that agree in source, id and size stand together in lots of so many.
LOT = 4096
#: Fixed value: the largest prime below 2^31; it shares no factor with a number of blocks that is smaller.
PRIME = 2147483647
WEIGHTS = (5, 2, 1)


def number(*columns: Column) -> Column:
    """60 bits of the MD5 digest of columns as text, null being ``null``: the seeded hash, which other engines have as well."""
    shown = [F.coalesce(c.cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *shown)), 1, 15), 16, 10).cast("bigint")


def apportion(votes: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: seats by highest quotients votes / (2k + 1), equal ones to the first, none beyond its most.

    Those that a divisor gives which is surely too high are seated at once, the others one by one.
    """
    n, total = len(votes), float(votes.sum())
    seats = min(int(seats), int(most.sum()))
    given = np.zeros(n, np.int64)
    if seats > n and total > 0:
        given = np.minimum(most, np.floor(votes / (total / (seats - n)) + 0.5).astype(np.int64))
    queue = [(-votes[i] / (2 * given[i] + 1), i) for i in range(n) if given[i] < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = queue[0]
        given[i] += 1
        if given[i] < most[i]:
            heapq.heapreplace(queue, (-votes[i] / (2 * given[i] + 1), i))
        else:
            heapq.heappop(queue)
    return given


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sources (source, size, ...) with rank, weight, target: weights repeat down the sources by code point, null last, and
    share the sum of all sizes; a target stops at ``most`` times the source's size, and what is above is shared again.

    Ranks come from range-partitioned rows and the partitions' counts, and each round of sharing is one aggregation: no
    task or driver holds the list of sources.
    """
    spark = sources.sparkSession
    where = F.spark_partition_id()
    placed = sources.orderBy(F.col("source").asc_nulls_last()).select("*", where.alias("piece"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("place"))
    placed, _ = materialize(placed, "mix-sources")
    begins, at = [], 0
    for piece, n in sorted((r[0], r[1]) for r in placed.groupBy("piece").count().collect()):  # a row for each partition
        begins.append((piece, at))
        at += n
    ranked = placed.join(F.broadcast(spark.createDataFrame(begins, "piece int, begin bigint")), "piece").withColumn("rank", F.col("begin") + F.col("place"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")).drop("piece", "place", "begin")
    exact = lambda x: F.lit(str(x)).cast("decimal(38,0)") if isinstance(x, int) else x.cast("decimal(19,0)")
    total, level_weight = (int(x or 0) for x in ranked.agg(F.sum("size"), F.sum("weight")).first())
    level_size, above = total, F.lit(False)
    while level_weight:
        above = exact(F.col("weight")) * F.lit(level_size).cast("decimal(19,0)") > exact(F.col("size")) * F.lit(most * level_weight).cast("decimal(19,0)")
        held, weighed = ranked.where(above).agg(F.coalesce(F.sum("size"), F.lit(0)) * most, F.coalesce(F.sum("weight"), F.lit(0))).first()
        now = (total - int(held), int(ranked.agg(F.sum("weight")).first()[0]) - int(weighed))
        if now == (level_size, level_weight):
            break
        level_size, level_weight = now
    share = (F.col("weight") * F.lit(level_size)).cast("double") / F.lit(level_weight or 1).cast("double")
    return ranked.withColumn("target", F.when(above, (F.col("size") * most).cast("double")).otherwise(share))


def _seats(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Quotas of the shards of one source, at most SHARDS rows."""

    def seat(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        quota = apportion(shards["words"].to_numpy(np.int64), most * shards["blocks"].to_numpy(np.int64), int(shards["seats"].iloc[0]))
        return shards.assign(quota=quota)[["rank", "shard", "words", "blocks", "quota"]]

    return seat


def taken(begin: Column, size: Column, words: Column, blocks: Column, quota: Column, turn: Column) -> Column:
    """How many words the shard's quota takes from what lies at begin .. begin + size of its words.

    Block k is words[k * words div blocks ..]; every block is taken quota div blocks times, and those whose place in the
    seeded order (k * PRIME + turn) mod blocks is below the remainder once more.
    """
    one = F.lit(1).cast("bigint")
    div = lambda a, b: F.call_function("div", a, b)
    edge = lambda k: div(k * words, blocks)
    # a block that holds a word w is at, or one beside, w * blocks div words
    low = F.greatest(div(begin * blocks, words) - one, F.lit(0).cast("bigint"))
    high = F.least(div((begin + size - one) * blocks, words) + one, blocks - one)
    more = F.aggregate(
        F.sequence(low, high),
        F.lit(0).cast("bigint"),
        lambda n, k: n + F.when((k * F.lit(PRIME) + turn) % blocks < quota % blocks, F.greatest(F.least(edge(k + one), begin + size) - F.greatest(edge(k), begin), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")),
    )
    return F.when(size > 0, size * div(quota, blocks) + more).otherwise(F.lit(0).cast("bigint"))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = BLOCK, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, taken, shard, quota, blocks) of every document.

    size: words of the text (none for null); target: the words that the source should give; taken: the words that the mix
    takes from the document, repeats counted, at most ``most`` times its size. quota: blocks taken from the document's
    shard, which has ``blocks`` of them. The same rows and seed give the same mix, in whatever partitions they come.

    Null and empty texts have size 0 and give nothing; a null source is a source, the last; a null key is a key; equal rows
    have rows of their own; a text of any length is counted whole; an empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    src = pick(df, key, source, text).toDF("key", "source", "text")
    rows = src.select("key", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    equal, _ = materialize(rows.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-rows")
    lots_of = F.ceil(F.col("copies") / F.lit(LOT)).cast("bigint")
    sources = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum(lots_of).alias("lots"))
    known = targets(sources, weights, most)
    # blocks of the source, each of size / n words: as many as make its block nearly ``block``
    n = F.greatest(F.round(F.col("size") / F.lit(block)), F.lit(1)).cast("bigint")
    shards = F.least(F.greatest(F.ceil(F.col("size") / F.lit(SHARD_WORDS)), F.ceil(F.col("lots") / F.lit(SHARD_LOTS)), F.lit(1)), F.lit(SHARDS)).cast("bigint")
    known = known.select(
        "source", F.col("size").alias("source_size"), "lots", "rank", "target", shards.alias("shards"), n.alias("source_blocks"),
        F.when(F.col("size") > 0, F.floor(F.col("target") / (F.col("size") / n) + F.lit(0.5))).otherwise(F.lit(0)).cast("bigint").alias("seats"),
    )
    known, _ = materialize(known, "mix-targets")
    lots = beside(equal, known, "source", "lots").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), lots_of - 1)))
    hashed = number(F.lit(seed), F.col("key"), F.col("size"), F.col("lot"))
    lots = lots.select(
        "rank", "key", "source", "size", "source_size", "source_blocks", "target", "seats", "shards", "lot",
        F.least(F.lit(LOT).cast("bigint"), F.col("copies") - F.col("lot") * LOT).alias("n"), (hashed % F.col("shards")).alias("shard"), hashed.alias("turn"),
    )
    lots, _ = materialize(lots, "mix-lots")
    cells = lots.groupBy("rank", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("source_size").alias("source_size"), F.first("source_blocks").alias("source_blocks"), F.first("seats").alias("seats"), F.first("shards").alias("shards"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.round(F.col("words").cast("double") * F.col("source_blocks") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(1))).otherwise(F.lit(0)).cast("bigint")
    cells, _ = materialize(cells.withColumn("blocks", blocks), "mix-cells")
    alone = cells.where("shards = 1").select("rank", "shard", "words", "blocks", F.least("seats", F.col("blocks") * most).alias("quota"))
    dealt = cells.where("shards > 1").groupBy("rank").applyInPandas(_seats(most), "rank bigint, shard bigint, words bigint, blocks bigint, quota bigint")
    quotas = alone.unionByName(dealt)
    order = Window.partitionBy("rank", "shard").orderBy("turn", F.col("key").asc_nulls_first(), "size", "lot")
    laid = lots.withColumn("begin", F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("n")).join(quotas, ["rank", "shard"])
    copies = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    turn = number(F.lit(seed), F.col("rank"), F.col("shard")) % F.lit(PRIME)
    got = taken(F.col("begin") + F.col("copy") * F.col("size"), F.col("size"), F.col("words"), F.col("blocks"), F.col("quota"), turn)
    return copies.select(F.col("key").alias(key), "source", "size", "source_size", "target", got.alias("taken"), "shard", "quota", "blocks")
