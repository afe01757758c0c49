"""Blocks as an importer forms them: a block ends before the row that is its n_variants-th, lies more than n_bases behind
its first position, or is on another contig; that row begins the next one.

Where a block ends depends on where it began, and so on back to the first row. That chain is cut into chunks of rows: each
chunk turns every row that may begin its first block into the row that begins the next chunk's, as a small array; such
arrays are composed by FAN at a time, up a tree and down again, so that every chunk learns its own first block in
log(chunks) rounds, and no task walks more than a chunk. Only positions and their counts are moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a chunk at least; chunks that are composed at once; blocks that are broadcast to rows at most.
CHUNK, FAN, BROADCAST = 1 << 16, 64, 100_000
_INDEX = "seq bigint, contig string, number bigint, n_variants bigint, min_pos bigint, max_pos bigint, skip bigint, until bigint, chunk bigint"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that the session names; in local mode, without one, in a temporary folder."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='locusframe-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _positions(df: DataFrame, n_variants: int, chunk: int) -> DataFrame:
    """(contig, pos, tie, begin, n, chunk, group): rows numbered over all contigs in order, begin being the number of the first
    of n rows at a position and tie that of the position's first. A group has its chunk's rows and those that follow it."""
    ordered = df.groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("n")).orderBy("contig", "pos")
    placed = kept(ordered.select("*", F.spark_partition_id().alias("piece")), "block-positions")
    begins, at = [], 0
    for piece, n in sorted((r[0], r[1]) for r in placed.groupBy("piece").agg(F.sum("n")).collect()):  # a row for each partition
        begins.append((piece, at))
        at += n
    before = F.sum("n").over(Window.partitionBy("piece").orderBy("contig", "pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    own = placed.withColumn("before", before).join(F.broadcast(df.sparkSession.createDataFrame(begins, "piece int, first bigint")), "piece")
    own = own.select("contig", "pos", (F.col("first") + F.col("before")).alias("tie"), F.col("n").alias("all"))
    # positions with many rows in parts, so that a chunk exceeds its size by n_variants at most
    parts = own.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("all") - 1) / n_variants))))
    parts = parts.select("contig", "pos", "tie", (F.col("tie") + F.col("k") * n_variants).alias("begin"), F.least(F.lit(n_variants).cast("bigint"), F.col("all") - F.col("k") * n_variants).alias("n"))
    parts = parts.withColumn("chunk", F.floor(F.col("begin") / chunk))
    follows = (F.col("begin") % chunk < 2 * n_variants) & (F.col("chunk") > 0)
    return parts.withColumn("group", F.explode(F.when(follows, F.array(F.col("chunk"), F.col("chunk") - 1)).otherwise(F.array("chunk"))))


def _steps(rows: pd.DataFrame, n_variants: int, n_bases: int) -> tuple[pd.DataFrame, np.ndarray, int, np.ndarray]:
    """(rows one by one, the row that begins the next block if one begins at each, how many are the chunk's own, keys)."""
    rows = rows.sort_values("begin")
    each = rows.loc[rows.index.repeat(rows["n"])].reset_index(drop=True)
    contig = (each["contig"] != each["contig"].shift()).cumsum().to_numpy(np.int64)
    key = (contig << 40) + each["pos"].to_numpy(np.int64)
    own = int((each["chunk"] == each["group"]).sum())
    reach = np.searchsorted(key, key[:own] + n_bases, "right")
    return each, np.minimum(np.arange(own) + n_variants, reach), own, key


def _function(n_variants: int, n_bases: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        _, leave, own, _ = _steps(rows, n_variants, n_bases)
        while (inside := np.flatnonzero(leave < own)).size:  # pointer doubling: paths get twice as long each time
            leave[inside] = leave[leave[inside]]
        entries = np.arange(n_variants)
        out = np.where(entries < own, leave[np.minimum(entries, own - 1)] - own, entries - own)
        return pd.DataFrame({"node": [int(rows["group"].iloc[0])], "f": [out.astype(np.int32)]})

    return of


def _formed(n_variants: int, n_bases: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        entry = int(rows["entry"].iloc[0])
        each, leave, own, _ = _steps(rows, n_variants, n_bases)
        starts = []
        while entry < own:
            starts.append(entry)
            entry = int(leave[entry])
        at = np.array(starts, np.int64)
        last = leave[at] - 1 if len(at) else at
        pos, tie, contig = (each[c].to_numpy() for c in ("pos", "tie", "contig"))
        first = int(each["begin"].iloc[0])
        out = pd.DataFrame({"contig": contig[at], "n_variants": last - at + 1, "min_pos": pos[at], "max_pos": pos[last], "skip": first + at - tie[at], "until": first + last - tie[last], "chunk": int(rows["group"].iloc[0])})
        out["seq"] = np.arange(len(at))
        out["number"] = out.groupby("contig").cumcount()
        return out[[x.split()[0] for x in _INDEX.split(", ")]]

    return of


def _entries(functions: DataFrame, n_variants: int) -> DataFrame:
    """(node, entry): for each chunk how many of its rows belong to a block that began before it."""
    levels, nodes = [], functions.count()
    while nodes > 1:
        own = functions.groupBy(F.floor(F.col("node") / FAN).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "f"))).alias("fs"))
        levels.append(kept(own, "block-level"))
        whole = F.aggregate("fs", F.sequence(F.lit(0), F.lit(n_variants - 1)), lambda at, x: F.transform(at, lambda v: F.get(x["f"], v)))
        functions = kept(levels[-1].select(F.col("parent").alias("node"), whole.alias("f")), "block-function")
        nodes = functions.count()
    entries = functions.select("node", F.lit(0).alias("entry"))
    for level in reversed(levels):
        met = level.join(entries.withColumnRenamed("node", "parent"), "parent")
        on = lambda i: F.aggregate(F.slice("fs", 1, i), F.col("entry"), lambda e, x: F.get(x["f"], e))
        entries = met.select(F.inline(F.transform("fs", lambda x, i: F.struct(x["node"].alias("node"), on(i).alias("entry")))))
    return entries


def block_index(df: DataFrame, n_variants: int = 1000, n_bases: int = 10_000_000, chunk: int = CHUNK) -> DataFrame:
    """(seq, contig, block_id, n_variants, min_pos, max_pos, skip, until) of each block, seq counting over all contigs and
    block_id being contig and number. Where rows of one position are in several blocks, those of a block are the ones from
    ``skip`` on at its min_pos and up to ``until`` at its max_pos. An empty table has no blocks."""
    n_variants = min(n_variants, 1 << 24)
    rows = kept(_positions(df.select("contig", "pos"), n_variants, max(chunk, 4 * n_variants)), "block-rows")
    functions = kept(rows.groupBy("group").applyInPandas(_function(n_variants, n_bases), "node bigint, f array<int>").where("node >= 0"), "block-function")
    entries = _entries(functions, n_variants)
    met = rows.join(entries.select(F.col("node").alias("group"), "entry"), "group")
    found = kept(met.groupBy("group").applyInPandas(_formed(n_variants, n_bases), _INDEX), "block-index")
    # a row for each chunk and contig: what earlier chunks hold is added
    counts = found.groupBy("chunk", "contig").agg(F.count(F.lit(1)).alias("n"))
    up_to = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    by_contig = counts.select("chunk", "contig", up_to(Window.partitionBy("contig").orderBy("chunk")).alias("numbers"))
    chunks = counts.groupBy("chunk").agg(F.sum("n").alias("n")).select("chunk", up_to(Window.partitionBy(F.floor(F.col("chunk") / (1 << 40))).orderBy("chunk")).alias("seqs"))
    out = found.join(by_contig, ["chunk", "contig"]).join(chunks, "chunk")
    return out.select((F.col("seq") + F.col("seqs")).alias("seq"), "contig", F.concat_ws(":", "contig", (F.col("number") + F.col("numbers")).cast("string")).alias("block_id"), "n_variants", "min_pos", "max_pos", "skip", "until")


def _ranked(df: DataFrame, shared: DataFrame) -> DataFrame:
    """df with __tie: at the (contig, pos) of shared, a row's place in the order of the hashes of whole rows, else 0. A position
    is numbered in 64 pieces, so that no task sees all of its rows."""
    key, names = ["contig", "pos"], df.columns
    marked = df.join(shared.select(*key, F.lit(True).alias("__shared")).distinct(), key, "left")
    plain = marked.where(F.col("__shared").isNull()).select(*names, F.lit(0).cast("bigint").alias("__tie"))
    own = marked.where("__shared").select(*names, F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("__hash"))
    own = own.withColumn("__piece", F.shiftrightunsigned("__hash", 58))
    sums = own.groupBy(*key, "__piece").agg(F.count(F.lit(1)).alias("n"))
    first = sums.select(*key, "__piece", (F.sum("n").over(Window.partitionBy(*key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__first"))
    place = F.row_number().over(Window.partitionBy(*key, "__piece").orderBy("__hash")) - 1
    return plain.unionByName(own.withColumn("__place", place).join(first, [*key, "__piece"]).select(*names, (F.col("__first") + F.col("__place")).alias("__tie")))


def _within(b: str) -> Column:
    after = (F.col("pos") > F.col(f"{b}min_pos")) | (F.col("pos") == F.col(f"{b}min_pos")) & (F.col("__tie") >= F.col(f"{b}skip"))
    return after & ((F.col("pos") < F.col(f"{b}max_pos")) | (F.col("pos") == F.col(f"{b}max_pos")) & (F.col("__tie") <= F.col(f"{b}until")))


def blocks(df: DataFrame, n_variants: int = 1000, n_bases: int = 10_000_000, index: DataFrame | None = None) -> DataFrame:
    """Add seq and block_id of ``block_index``.

    Blocks are met by classes of their length: one of up to 2^k bases lies in at most two cells of that width, and as blocks
    do not overlap, a cell holds few of its class. A row looks into one cell of each class.
    """
    index = kept(block_index(df, n_variants, n_bases), "block-index") if index is None else index
    names = df.columns
    ranked = _ranked(df, index.where("skip > 0").select("contig", F.col("min_pos").alias("pos")))
    own = index.select("seq", "block_id", F.col("contig").alias("b_contig"), *[F.col(c).alias(f"b_{c}") for c in ("min_pos", "max_pos", "skip", "until")])
    length = F.ceil(F.log2(F.col("b_max_pos") - F.col("b_min_pos") + 1)).cast("int")
    own = own.withColumn("b_class", length)
    classes = sorted(r[0] for r in own.select("b_class").distinct().collect())  # as many as bits of a length
    cell = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k)).cast("bigint")
    own = own.withColumn("b_cell", F.explode(F.array_distinct(F.array(cell("b_min_pos", F.col("b_class")), cell("b_max_pos", F.col("b_class"))))))
    if index.count() <= BROADCAST:
        own = F.broadcast(own)
    asked = ranked.withColumn("__class", F.explode(F.array(*[F.lit(k) for k in classes]) if classes else F.array().cast("array<int>")))
    met = asked.join(own, (F.col("contig") == F.col("b_contig")) & (F.col("__class") == F.col("b_class")) & (cell("pos", F.col("__class")) == F.col("b_cell")) & _within("b_"))
    return met.select(*names, "seq", "block_id")


def read_block(df: DataFrame, block_id: str, n_variants: int = 1000, n_bases: int = 10_000_000, index: DataFrame | None = None) -> DataFrame:
    """The rows of one block: its positions are a predicate on df, which prunes what is read. index: one made before."""
    index = block_index(df, n_variants, n_bases) if index is None else index
    own = index.where(F.col("block_id") == block_id).first()
    if own is None:
        raise ValueError(f"no such block: {block_id!r}")
    rows = df.where((F.col("contig") == own.contig) & F.col("pos").between(own.min_pos, own.max_pos))
    ends = df.sparkSession.createDataFrame([(own.contig, own.min_pos), (own.contig, own.max_pos)], "contig string, pos bigint")
    bound = {c: F.lit(own[c]) for c in ("min_pos", "max_pos", "skip", "until")}
    found = _ranked(rows, ends).withColumns(bound).where(_within(""))
    return found.select(*df.columns)
