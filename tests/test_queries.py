"""Every registered query against its SQL, at the smallest size."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return str([cell(y) for y in x])
    if pd.isna(x):
        return "~"
    if isinstance(x, float):
        return f"{x:.8g}"
    return str(x)


def lines(df):
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_oracle_has_a_query():
    assert SQL.keys() <= QUERIES.keys() and "bm25_topk" in QUERIES


@pytest.mark.parametrize("name", sorted(k for k in SQL if not k.startswith("op")))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert lines(got) == lines(want)


def test_entry_runs(spark):
    assert {"query_id", "chunk_id", "score", "rank"} <= set(__spark_entry__.entry(spark).columns)
