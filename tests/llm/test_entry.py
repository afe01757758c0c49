from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 14)} and "pipeline" in names


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline
    from locusframe.llm.common import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, _ = materialize(stage(spark, docs, str(DATA)), "test")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        assert n == 4 or docs.columns == columns
        ids = now
    assert docs.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op7_fm_index_decontamination", "op8_warc_revisits", "op12_sainte_lague_mix", "op13_segment_mean_codes"])
def test_against_sql(spark, name):
    import duckdb

    from locusframe.llm import queries

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries.queries()[name](spark, str(DATA))
    theirs = con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(theirs, key=repr)
