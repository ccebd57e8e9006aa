"""The driver's contract: names, schemas, and results against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_names():
    assert set(SQL) <= set(entry.queries())
    for n in range(1, 4):
        assert f"p{n}_found" in entry.queries()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "score"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(tuple(r[c] for c in cols) for r in df.collect())
    cur = oracle.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == plain(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(rows[0]) == len(df.columns)
