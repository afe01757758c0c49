"""Every named query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from locusframe.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalog.queries()[name](spark, str(DATA))
    sql = catalog.oracle_sql()[name]
    types = {r[0]: r[1] for r in con.execute("describe " + sql).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    theirs = con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({sql})").fetchall()
    assert mine == sorted(theirs, key=repr)
    assert mine


def test_queries_without_sql(spark):
    import json

    q = catalog.queries()
    value = json.loads(q["stats_json"](spark, str(DATA)).first().value)
    assert set(value) == {"VI", "PSI"} and len(value["PSI"]) == 7 and len(value["VI"]["n_alts"]) == 32
    assert len(value["PSI"]["s0"]["conv"]) == 9 and sum(value["PSI"]["s0"]["in_dist"]) == value["PSI"]["s0"]["n_ins"]
    assert q["block_digest"](spark, str(DATA)).count() > 0
