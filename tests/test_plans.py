"""Plan guards over every registered query: no cartesian products or nested-loop joins, and scans
read only the columns a query uses."""

import __spark_entry__ as E
from conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairs_in_any_registered_plan(spark):
    bad = {}
    for name, fn in E.queries().items():
        plan = plan_of(fn(spark, SF001))
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_column_pruning_reaches_the_scan(spark):
    plan = plan_of(E.queries()["prep_transform_test"](spark, SF001))
    schema = plan[plan.index("ReadSchema: struct<"):].split(">", 1)[0]
    assert "o_orderdate" not in schema and "o_totalprice" in schema
