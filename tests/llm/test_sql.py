"""The SQL of the queries agrees with them, on whole small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.llm import oracle, sharding
from quillmill.llm.common import read_table
from quillmill.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return con


def rows(table, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLE[name])
    assert rows(map(tuple, df.collect()), df.columns) == rows(cur.fetchall(), [d[0] for d in cur.description])


@pytest.mark.parametrize("limit", [20_000, 100_000])
def test_sharding_agrees_with_sql_at_small_limits(spark, duck, limit):
    docs = read_table(spark, DATA, "documents")
    df = sharding.assign(docs, ["doc_id"], limit).select("doc_id", "row_bytes", "shard", F.col("depth"))
    cur = duck.execute(oracle.sharding(limit))
    assert rows(map(tuple, df.collect()), df.columns) == rows(cur.fetchall(), [d[0] for d in cur.description])
