"""Every operator and stage over nulls in any column, empty and very long texts, ties, repeats, clashing names, and nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusframe.llm import bpe, common, decontam, hmm, htmltext, langid, licenses, quality, queries, sharding, simhash, warc

LONG = "Der lange Text hat viele Wörter und kein Ende. " * 40_000  # 1.9 MB
ROWS = [
    (1, None, "de", "s", 0, 1), (2, "", None, None, 0, None), (3, " \t\n", "de", "s", 3, 1), (None, "only words without an id", None, None, None, 2),
    (4, LONG, "de", "s", len(LONG), 1), (5, "same words here", "en", "s", 15, 1), (5, "same words here", "en", "s", 15, 1), (6, "same words here", "en", "s", 15, 1),
    (7, "\u0000 zero 日本語 \U0001f600 Licensed under MIT", "en", "t", 9, 3), (8, "12 34 ## $$", "xx", "t", 11, 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `TEXT` int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "words without an id"), (1, "words without an id"), (2, None), (None, "")], "item_id long, text string")


def by_document(spark):
    vocabulary = bpe.Vocabulary.load(queries.tokenizer_path())
    return {
        "op1": lambda d, _: sharding.shard(d),
        "op2": lambda d, _: quality.judge(d, quality.fit(d)),
        "op4": lambda d, _: langid.predict(d, langid.fit(d)),
        "op5": lambda d, _: hmm.score(d, rounds=1),
        "op6": lambda d, _: bpe.digests(bpe.round_trip(d, vocabulary)),
        "op7": lambda d, i: decontam.contract(decontam.mark(d, i)),
        "op9": lambda d, _: simhash.contract(simhash.near_duplicates(d)),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op9"])
def test_one_row_for_each_row(spark, docs, items, name):
    run = by_document(spark)[name]
    got = run(docs, items).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    ignored = {"slot", "n"}
    fives = [{k: v for k, v in r.asDict().items() if k not in ignored} for r in got if r.doc_id == 5]
    assert fives[0] == fives[1]
    assert run(docs.limit(0), items).count() == 0 and run(docs.limit(0), items.limit(0)).count() == 0


def test_licenses_and_pages(spark, docs):
    assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [(7, "MIT")] and licenses.scan(docs.limit(0)).count() == 0
    pages = docs.toDF("doc_id", "text", "lang", "source", "n_chars", "more").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), "source", F.lit(1).alias("HTML"))
    got = htmltext.extract(pages).collect()
    assert len(got) == len(ROWS) and max(r.n_chars for r in got) == len(LONG.strip()) and sum(r.text == "" for r in got) >= 3
    back = warc.round_trip(pages.drop("source")).collect()
    assert sorted(str(r.page_id) for r in back) == sorted(str(r[0]) for r in ROWS) and max(r.payload_bytes for r in back) == len(LONG.encode()) + 3
    named = pages.withColumn("page_id", F.concat(F.lit("id-"), "page_id"))
    assert {r.page_id for r in warc.round_trip(named).collect()} == {None if r[0] is None else f"id-{r[0]}" for r in ROWS}


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, items, tmp_path, stage):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    fn = dict(corpus_pipeline.STAGES)[stage]
    got = fn(spark, docs, str(tmp_path))
    rows = got.collect()
    assert fn(spark, docs.limit(0), str(tmp_path)).count() == 0
    if stage == "encoding":
        assert len(rows) == len(ROWS)
        return
    assert got.columns == docs.columns
    ids = sorted(str(r[0]) for r in rows)
    want = {
        "quality_rules": [],  # too short, or one line over and over
        "language_id": ids,
        "near_dedup": ["1", "4", "5", "7", "8", "None"],  # one without words, one of the equal ones
        "decontamination": sorted(str(r[0]) for r in ROWS),
    }[stage]
    assert ids == want
    if stage == "decontamination":
        assert [r[1] for r in rows if r[0] is None] == ["only "] and [r[4] for r in rows if r[0] is None] == [5]
    if stage == "language_id":
        assert not {"1", "2", "3"} & set(ids) and "4" in ids


def test_scratch_tables_go(spark, docs):
    docs = docs.select("doc_id")
    with common.scratch(spark) as keep:
        _, a = common.materialize(docs, "edge")
        b, path = common.materialize(docs, "edge")
        keep.add(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(a).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(a)) and b.count() == len(ROWS)
