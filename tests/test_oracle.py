"""Every query with SQL agrees with DuckDB; every query without one gives a stable schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_norm(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cur = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
