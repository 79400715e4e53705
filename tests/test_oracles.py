"""Every query with a SQL twin gives the same rows on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(canonical(r[c]) for c in columns)) for r in df.collect())
    relation = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(canonical(r[i]) for i in places)) for r in relation.fetchall())
    assert ours == theirs


def test_sql_twins_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_runs(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 8 and sum(r["n"] for r in rows) == 2 * 18
