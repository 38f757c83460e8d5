"""Every registered query against its SQL, value by value, on the smallest data."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module
from cashtide.plans.oracles import ORACLES
from cashtide.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 31


# Operators no plan may contain.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [op for op in FORBIDDEN if op in plan] == []
    assert differences(df, con, ORACLES[name]) == []


# Queries that may find nothing on small data.
MAY_BE_EMPTY = {"erasure_log"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MAY_BE_EMPTY))
def test_sql_is_not_empty(con, name):
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchall()[0][0] > 0
