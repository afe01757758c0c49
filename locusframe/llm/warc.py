"""Deduplicated WARC archives: revisit resolution by payload digest.

Writing: the headers (digest, page id) of payloads of at least LEAST bytes are shuffled by digest; a digest that occurs
more than once has one original, the largest page id. Pages join their original: it becomes the response, the others
become revisit records without payload, under fresh headers. Archives are gzip files in any file system Spark knows.

Reading: a task gets whole files, line by line and in order, cuts records by their Content-Length and checks each
payload against its digest; revisits then join the responses of their digest.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, map_batches, materialize, pick, scratch_path

#: Payloads under this size are never replaced by a revisit.
LEAST = 1000
#: Originals (about 60 bytes each) are broadcast up to this number; beyond, pages are shuffled by digest and a salt.
FEW, SALTS = 100_000, 16
# Names and profile of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _originals(heads: DataFrame, least: int) -> DataFrame:
    return heads.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "original")


def _beside(rows: DataFrame, originals: DataFrame, by: list[str], spread: str) -> DataFrame:
    """Rows joined to their originals, a stored table: broadcast where these are few, else shuffled with a salt, as a third of
    all rows may share one original."""
    if originals.count() <= FEW:
        return rows.join(F.broadcast(originals), by, "left")
    salted = originals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*by, "salt"], "left")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _fields(*pairs: tuple[str, Column | str]) -> Column:
    parts: list[Column] = []
    for name, value in pairs:
        parts += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END)]
    return F.concat(*parts)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", page: str = "html", least: int = LEAST, date: str | None = None) -> None:
    """Write one record per row of pages to gzip WARC files under path.

    A null page is an empty payload; control characters and spaces of a URL are escaped, a null URL is empty; rows that
    repeat the largest id of their payload are all responses; null ids are named ``null`` and are original only where no
    other is. An empty table makes an archive without records. Other columns are ignored.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    src = pick(pages, key, url, page).toDF("id", "url", "page")
    rows = src.select("id", F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("")).alias("url"), F.coalesce("page", F.lit("")).alias("page"))
    rows = rows.withColumn("size", F.octet_length("page")).withColumn("digest", F.sha1(F.col("page").cast("binary")))
    originals, kept = materialize(_originals(rows.select("id", "size", "digest"), least), "warc-originals")
    joined = _beside(rows, originals, ["digest"], "id")
    revisit = F.col("original").isNotNull() & (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("original"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    length = F.octet_length(http)
    common = [("WARC-Record-ID", _record_id(F.col("id"))), ("WARC-Date", date), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", "application/http; msgtype=response")]
    response_head = _fields(("WARC-Type", "response"), *common, ("Content-Length", (length + F.col("size")).cast("string")))
    revisit_head = _fields(("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(F.col("original"))), ("Content-Length", length.cast("string")))
    record = F.concat(F.lit(VERSION + END), F.when(revisit, revisit_head).otherwise(response_head), F.lit(END), http, F.when(revisit, F.lit("")).otherwise(F.col("page")))
    joined.select(record.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").text(path)
    delete(pages.sparkSession, kept)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a stream of bytes that arrives in any pieces."""
    held = bytearray()
    at = 0
    for piece in stream:
        del held[:at]
        at = 0
        held += piece
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = held[at:end].decode("utf-8", "replace").split("\r\n")
            if lines[0] != VERSION:
                raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            size = int(fields["Content-Length"])
            if len(held) < end + 8 + size:
                break
            yield fields, bytes(held[end + 4 : end + 4 + size])
            at = end + 8 + size
    if len(held) > at:
        raise ValueError("an archive ends within a record")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def pack() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), (), ()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["id", "type", "digest", "refers", "size"])
        rows.clear()
        return out

    lines = (b"\n".join([*b.column(0).to_pylist(), b""]) for b in batches if b.num_rows)
    for fields, block in records(lines):
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is not that of its digest")
        name = lambda x: fields.get(x, "").removeprefix("<urn:page:").removesuffix(">")
        rows.append((name("WARC-Record-ID"), kind, digest, name("WARC-Refers-To"), len(payload)))
        if len(rows) >= 10_000:
            yield pack()
    yield pack()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, digest, refers, size) of each record of the archives under path; ids as text, size of its own payload."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return map_batches(lines, _parse, "id string, type string, digest string, refers string, size bigint")


def resolve(found: DataFrame, kind: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): each revisit joined to the response it refers to.

    kind: the type of page ids, which archives hold as text. The id ``null`` is null; an empty archive gives no rows; a
    revisit whose response is in another archive stays, its payload_bytes null.
    """
    page = lambda c: F.when(F.col(c) != "null", F.col(c).cast(kind))
    responses = found.where("type = 'response'")
    revisits = found.where("type = 'revisit'")
    wanted = revisits.select("refers", "digest").distinct()
    sizes = responses.groupBy(F.col("id").alias("refers"), "digest").agg(F.max("size").alias("full"))
    originals, _ = materialize(sizes.join(wanted, ["refers", "digest"]), "warc-referred")
    revisits = _beside(revisits, originals, ["refers", "digest"], "id")
    columns = lambda size, to: [page("id").alias("page_id"), F.col(size).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), to.cast(kind).alias("refers_to")]
    return responses.select(*columns("size", F.lit(None))).unionByName(revisits.select(*columns("full", page("refers"))))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read these back and resolve their revisits.

    Nulls, empty pages, repeated rows and clashing names as in ``write``; payloads of any length go whole into a record.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    found, _ = materialize(read(spark, path), "warc-records")
    delete(spark, path)
    return resolve(found, pick(pages, "page_id").schema[0].dataType.simpleString())
