"""The registered SQL against the queries, row by row."""

import os

import duckdb
import pytest
from helpers import TABLES

from tributary.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{TABLES}/{f}'")
    cursor = c.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_eleven_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
