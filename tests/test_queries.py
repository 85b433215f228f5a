"""Every library query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from folioforge import queries

DATA = "/root/testdata/sf0.001"


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return str(v)[:10] if hasattr(v, "year") else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted((tuple(value(r[c]) for c in names) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    b = sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_merge_chains_and_cycles(spark):
    from folioforge.operators.identity import follow_merges

    spark.sparkContext.setCheckpointDir("/tmp/folioforge-test")
    got = follow_merges(spark.createDataFrame([(1, 2), (2, 3), (4, 3), (8, 9), (9, 8)], "loser int, winner int"), 6)
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 3), (4, 3)]


def test_sessions_split_over_the_gap_only(spark):
    from folioforge.operators.sessions import sessionize

    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:30:00"), (3, "2024-01-01 01:00:01")]
    e = spark.createDataFrame(rows, "id int, t string").selectExpr("id", "cast(t as timestamp) as ts", "1 as v")
    assert [r.session_no for r in sessionize(e, ["v"]).orderBy("id").collect()] == [0, 0, 1]


def test_names_are_used_once():
    assert len(queries.queries()) == sum(len(m.QUERIES) for m in queries.MODULES)
