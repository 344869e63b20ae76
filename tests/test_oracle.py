"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from textquarry.plans import core_queries, more_queries, snapshot_queries

QUERIES = {**snapshot_queries.QUERIES, **core_queries.QUERIES, **more_queries.QUERIES}
SQL = {**snapshot_queries.SQL, **core_queries.SQL, **more_queries.SQL}


def cell(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(cell(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(cell(r[c]) for c in cols)) for r in df.collect())
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = Counter(repr(tuple(cell(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
        assert got == want


def test_registry_has_the_core():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["snapshot_id", "path", "change_type"]
