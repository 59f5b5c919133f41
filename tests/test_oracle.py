"""Every query with oracle SQL gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pytest

from callmeter.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    return cols, sorted(map(tuple, frame.where(frame.notna(), None).astype(str).replace(r" 00:00:00$", "", regex=True).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    catalog.QUERIES[name](spark, DIR).collect()


def test_band_joins_are_equi_joins(spark):
    from callmeter.operators import reconcile
    from callmeter.sources.adapter import usage_events

    plan = reconcile.shadowed_proxies(usage_events(spark, DIR, True))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
