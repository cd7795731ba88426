"""Every query with SQL gives the rows that DuckDB gives, over whole tables of the smallest size."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from dev.compare import TABLES

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def names():
    from trialgrid import catalog

    return [n for n in catalog.QUERIES if n in catalog.SQL]


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from dev.compare import canon
    from trialgrid import catalog

    ours, theirs = canon(catalog.QUERIES[name](spark, SF).toPandas()), canon(duck.sql(catalog.SQL[name]()).df())
    assert list(ours.columns) == list(theirs.columns) and ours.equals(theirs)


def test_entry_runs_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in ("trialgrid.llm", "trialgrid.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert "cell_deltas" in entry.queries() and "pipeline" not in entry.queries()
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.oracle_sql())
