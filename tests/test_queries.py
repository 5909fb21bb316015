"""Every query with SQL gives the same rows as DuckDB, and plans hold no cartesian product or Python worker."""

import glob
import math
import os

import pytest

from parcelry.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    assert got
    if name in ORACLES:
        want = duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
        assert got == sorted((tuple(plain(v) for v in r) for r in want), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["risk_scorecard", "hmda_risk", "risk_by_metro"])
def test_applications_are_read_once(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # what ran in the end
    assert plan.count("lineitem.parquet") == plan.count("orders.parquet") == 1
