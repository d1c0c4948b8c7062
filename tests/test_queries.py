"""Every query that has SQL is compared with it on a small table; the others must run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from inkwell.oracles import SQL
from inkwell.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    expected = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
