"""The catalogue against DuckDB, and the entry points."""

import os

import duckdb
import pandas as pd
import pytest
from tables import TABLES

from tributary import lifecycle as q
from tributary import queries as first


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{TABLES}/{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(None if pd.isna(r[i]) else r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, TABLES)
    cursor = duck.execute(q.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(cursor.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1500 and "__pc_row" in df.columns
    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())


def test_pruning(spark, tmp_path):
    """Unused columns aren't read, and a coordinate prunes the other source's branch."""
    df = first.flagship(spark, TABLES)
    text = df.where("__pc_source = 1").select("o_orderkey", "__pc_row")._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "o_amount" not in text.split("ReadSchema")[1].split("\n")[0]
