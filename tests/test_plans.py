"""Physical-plan properties: no cross products or nested-loop joins anywhere; scans read only needed columns."""

import pytest

from indexspark.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()
QUERIES = dict(registry.QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_column_pruning_and_pushdown(spark):
    plan = QUERIES["trend_slope"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan or (
        "o_comment" not in plan and "o_orderpriority" not in plan
    )
    plan = QUERIES["anti_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(l_returnflag,R)" in plan


def test_pre_aggregation_before_dimension_join(spark):
    from indexspark.sources.tables import Tables, nation_year_revenue

    plan = _plan(nation_year_revenue(Tables(spark, SF)))
    # orders are partially aggregated per (customer, year) below the customer join, so a hot customer collapses
    # to one row per task and year before any shuffle
    assert "keys=[o_custkey" in plan and "partial_sum(o_totalprice" in plan
    join_at = plan.find("Join")
    assert join_at != -1 and plan.find("keys=[o_custkey") > join_at
