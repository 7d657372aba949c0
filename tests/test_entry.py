from pathlib import Path

import pytest

import __spark_entry__ as entry
from shirabe import queries as core

DATA = Path("/root/testdata/sf0.001")


def test_registry():
    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_flagship_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rows = con.execute(entry.oracle_sql()["extract_terms_by_doc"])
    names = [d[0] for d in rows.description]
    want = {(r[names.index("doc_id")], r[names.index("rank")], r[names.index("term")], r[names.index("frequency")], round(r[names.index("score")], 4)) for r in rows.fetchall()}
    got = {(r["doc_id"], r["rank"], r["term"], r["frequency"], round(r["score"], 4)) for r in entry.entry(spark).collect()}
    assert got == want
