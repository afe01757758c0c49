"""Shared plumbing of the corpus operators: column picking, scratch tables, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Lower-cases A-Z only, as the contracts ask; other letters keep their case.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, first match, whatever other columns (also names that differ in case only) exist."""
    columns = df.columns
    if len({c.lower() for c in columns}) == len(columns):
        return df.select(*[f"`{n}`" for n in names])
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[plain[f"c{columns.index(n)}"].alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names. Where none is set, local mode takes a temporary one; a cluster, whose executors
    could not see that, is told to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="locusframe-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Paths given out within ``scratch``, if any is open.
_GIVEN: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for given in _GIVEN:
        given.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes, at its end, every scratch table made within, but for those put into the set that it gives.

    Operators return plans that still read their scratch tables: close this only when their results are written.
    """
    given: list[str] = []
    keep: set[str] = set()
    _GIVEN.append(given)
    try:
        yield keep
    finally:
        _GIVEN[:] = [g for g in _GIVEN if g is not given]  # by identity: lists of equal paths are not the same one
        for path in given:
            if path not in keep:
                delete(spark, path)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later plan reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows, and bytes of all columns, that an operator gets at once: Arrow batches are cut into such pieces. One longer row is
#: a piece of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def pieces(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes; nothing is copied."""
    if batch.num_rows <= rows and batch.nbytes <= size:
        yield batch
        return
    a, n = 0, batch.num_rows
    while a < n:
        b = min(n, a + rows)
        while b - a > 1 and batch.slice(a, b - a).nbytes > size:
            b = a + (b - a) // 2
        yield batch.slice(a, b - a)
        a = b


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches under the first one's schema with every field nullable: a task's batches must not differ in that."""
    schema = None
    for b in batches:
        if schema is None:
            schema = pa.schema([pa.field(f.name, f.type) for f in b.schema])
        yield pa.RecordBatch.from_arrays(b.columns, schema=schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over rows with texts, in pieces of bounded rows and bytes.

    What arrives from the JVM is bounded by the session's spark.sql.execution.arrow.maxBytesPerBatch (64 MiB unless set)
    and one row; the session's settings are left as they are.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from alike(fn(piece for b in batches for piece in pieces(b)))
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage, and what they once needed would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keep_rows(df: DataFrame, columns: tuple[str, ...], keep: Callable[[Iterator[list[list]]], Iterator[list[bool]]]) -> DataFrame:
    """Filter whole rows by a batched Python decision over some columns; all columns pass through untouched, also clashing names."""
    names = df.columns
    at = [names.index(c) for c in columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def feed() -> Iterator[list[list]]:
            for b in batches:
                held.append(b)
                yield [b.column(i).to_pylist() for i in at]

        for mask in keep(feed()):
            yield held.pop(0).filter(pa.array(mask, pa.bool_()))

    return map_batches(plain, run, plain.schema).toDF(*names)


def beside(rows: DataFrame, groups: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """rows with the columns of their group beside them; groups has one row for each value of key, null included.

    n: the column of groups that counts a group's rows. Groups of over 1/share of all rows, thus fewer than share of them,
    are broadcast, so that no hot key is shuffled; rows of the others meet theirs in a join by key. Both tables should be
    cheap to read twice (written ones).
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    other = groups.withColumnRenamed(key, "_key")
    hot = other.where(F.col(n) * F.lit(share) > F.lit(total))
    cold = other.where(F.col(n) * F.lit(share) <= F.lit(total))
    met = rows.join(F.broadcast(hot), rows[key].eqNullSafe(hot["_key"]), "left")
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    rest = met.where(F.col(n).isNull()).select(*rows.columns)
    return met.where(F.col(n).isNotNull()).select(*columns).unionByName(rest.join(cold, rest[key].eqNullSafe(cold["_key"])).select(*columns))
