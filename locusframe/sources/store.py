"""The store: Parquet partitioned by contig, sorted by position within files, with the header beside it."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from ..operators import runs as packed
from ..session import ship
from .header import Header

#: Rows of a file at most, where wide genotype arrays would make files of the usual number of rows too large.
ROWS = 1_000_000


def write_store(df: DataFrame, header: Header, path: str, rows: int = ROWS, level: int = 6, keys: Mapping[str, bytes] | None = None, runs: bool = False) -> None:
    """zstd Parquet by contig; ranges of (contig, position) are dealt out, so that one long contig has many tasks.

    Row groups then have narrow position ranges, which is what prunes region queries. keys: columns that are encrypted
    value by value, each by its key; their types are written beside the header, in the clear. runs: genotypes are stored as
    runs of samples with equal calls, from which annotations are counted without expanding them.
    """
    keys = keys or {}
    if runs:
        if "gt" in keys:
            raise ValueError("runs cannot be encrypted")
        df = packed.with_runs(df)
    else:
        df = df.drop(packed.RUNS)
    if bad := [c for c in keys if c in ("contig", "pos") or c not in df.columns]:
        raise ValueError(f"cannot be encrypted: {bad[0]!r}")
    types = {c: df.schema[c].dataType.simpleString() for c in keys}
    df = integrity.encrypt(df, keys) if keys else df
    dealt = df.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos")
    dealt.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("maxRecordsPerFile", rows).partitionBy("contig").parquet(path)
    # names that begin with an underscore are no data to Spark's readers of the folder
    df.sparkSession.createDataFrame([(0, header.to_json()), (1, json.dumps(types))], "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{path}/_header")


def _sidecar(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(f"{path}/_header").collect()]  # two lines


def read_header(spark: SparkSession, path: str) -> Header:
    return Header.from_json(_sidecar(spark, path)[0])


def read_store(spark: SparkSession, path: str, keys: Mapping[str, bytes] | None = None, on_error: str = "raise") -> tuple[DataFrame, Header]:
    """(variants, header). Of a store of runs, ``gt`` is there as well; it is expanded only where something asks for it. Encrypted
    columns without a key stay ciphertexts; a wrong key is an error once values are asked for, or, with on_error="null", makes them null."""
    side = _sidecar(spark, path)
    types = json.loads(side[1]) if len(side) > 1 else {}
    df = spark.read.parquet(path)
    df = df.withColumn("contig", F.col("contig").cast("string")).select("contig", *[c for c in df.columns if c != "contig"])
    if packed.RUNS in df.columns:
        df = df.withColumn("gt", packed.expand())
    own = {c: k for c, k in (keys or {}).items() if c in types}
    return integrity.decrypt(df, own, types, on_error) if own else df, Header.from_json(side[0])


def storage_report(spark: SparkSession, path: str) -> DataFrame:
    """(column, compressed, uncompressed, n_values) of each Parquet column, from the files' footers, read by executors.

    Needs paths that Python can open on the executors (local or mounted); the footers are all that is read.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in batches:
            rows: dict[str, list[int]] = {}
            for p in b.column(0).to_pylist():
                meta = pq.ParquetFile(p.removeprefix("file:").replace("///", "/")).metadata
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        m = meta.row_group(g).column(c)
                        own = rows.setdefault(m.path_in_schema, [0, 0, 0])
                        for i, x in enumerate((m.total_compressed_size, m.total_uncompressed_size, m.num_values)):
                            own[i] += x
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *(pa.array([r[i] for r in rows.values()], pa.int64()) for i in range(3))], ["column", "compressed", "uncompressed", "n_values"])

    parts = files.mapInArrow(run, "column string, compressed bigint, uncompressed bigint, n_values bigint")
    return parts.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("compressed", "uncompressed", "n_values")])
