"""Queries over whole tables against DuckDB on the smallest tables; skipped where those are absent."""

import os

import pytest

from gridloom.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def compare(spark, name, table, key, column):
    """The rows equal the SQL's, and every key of the table that may have a row has one."""
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[cols].astype(object).values.tolist()))
    assert cols == sorted(got.columns) and rows(want) == rows(got)
    return set(got[column]), {r[0] for r in con.sql(f"select {key} from {table}").fetchall()}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["range_mask", "point_distance", "wkb_point_distance"])
def test_every_trip_has_a_row(spark, name):
    got, every = compare(spark, name, "orders", "o_orderkey", "tripkey")
    assert got == every


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name, column", [("join_within_distance_geo", "a"), ("wkb_polygons_join", "id"), ("scan_and_sink", "id")])
def test_every_probe_may_be_joined(spark, name, column):
    table, key = ("embeddings", "vec_id") if column == "a" else ("customer", "c_custkey")
    got, every = compare(spark, name, table, key, column)
    assert got <= every and {k % 2 for k in got} == {0, 1}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_every_group_has_a_hull(spark):
    got, _ = compare(spark, "hull_area_by_group", "customer", "c_custkey", "custkey")
    assert {k % 7 for k in got} == set(range(7))
