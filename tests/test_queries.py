"""Each registered query against its SQL, at the smallest scale."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

from tallyrill.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


def test_all_have_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ts", "value"]
    assert QUERIES.keys() <= __spark_entry__.queries().keys() and ORACLE_SQL.keys() <= __spark_entry__.oracle_sql().keys()


def test_entry_without_what_llm_needs(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("tallyrill.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries().keys() == QUERIES.keys() and entry.oracle_sql().keys() == ORACLE_SQL.keys()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
