"""Arrow batches of few rows in one task, in which changed and unchanged ones alternate, and batches of many bytes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.llm import common, decontam, langid


@pytest.fixture
def two_rows(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    yield spark
    spark.conf.set(name, before)


def test_cut_and_clean_batches_in_one_task(two_rows):
    rows = [(i, "one two three four five six" if i % 4 == 3 else f"word{i} alone here") for i in range(24)]
    docs = two_rows.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long")).coalesce(1)
    items = two_rows.createDataFrame([(1, "two three four")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, items, size=3).collect()}
    assert got == {i: "one  five six" if i % 4 == 3 else t for i, t in rows}


def test_whole_rows_are_kept_in_one_task(two_rows):
    rows = [(i, "the cat sat on the mat" if i % 3 else "12 34", "en") for i in range(18)]
    docs = two_rows.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == {i for i, _, _ in rows if i % 3}


def test_pieces():
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (2000 if i == 7 else 10) for i in range(50)])], ["k", "t"])
    cut = list(common.pieces(b, rows=20, size=500))
    assert [k for p in cut for k in p.column(0).to_pylist()] == list(range(50))
    assert all(p.num_rows <= 20 and (p.nbytes <= 500 or p.num_rows == 1) for p in cut) and len(cut) < 12
    assert list(common.pieces(b)) == [b]


def test_texts_of_more_than_an_arrow_column_holds(spark):
    """2.4 GB of text in one task: a string column of a batch holds 2 GiB at most."""
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(0, 800, 1, 1).select("id", F.expr("repeat('abc ', 750000)").alias("t"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = common.map_batches(docs, run, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 800 and max(r["size"] for r in got) < 32 << 20
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
