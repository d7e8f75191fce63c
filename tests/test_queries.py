"""Every registered query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from silvane.plans import binary_queries, table_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_query(spark, duck, name):
    df = table_queries.QUERIES[name](spark, FOLDER)
    result = duck.execute(table_queries.SQL[name])
    columns = [c[0] for c in result.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
