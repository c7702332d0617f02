"""What the plans of the event queries must and must not contain."""

import pytest

from tidemark.plans import queries

SF = "/root/testdata/sf0.001"
MODELS = {"gbt_scores", "stream_silver", "stream_dedup", "stream_dedup_ttl", "stream_online_upsert", "framed_messages"}


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - MODELS))
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF)).split("== Physical Plan ==")[1]
    for node in ("Python", "Pandas", "MapInArrow", "CartesianProduct"):
        assert node not in plan, node


def test_filters_and_columns_reach_the_scan(spark):
    from tidemark.operators import gold
    from tidemark.plans.adapters import bronze

    plan = plan_of(gold.compute_funnel(bronze(spark, SF)))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][-1]
    assert "value" not in scan.split("ReadSchema")[1]
    table = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity > 45").select("l_orderkey")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan_of(table)


def test_aggregates_are_partial_before_the_shuffle(spark):
    plan = plan_of(queries.gold_funnel(spark, SF))
    assert "partial_count" in plan and "Exchange hashpartitioning" in plan


def test_dau_expands_reduced_rows(spark):
    plan = plan_of(queries.gold_dau(spark, SF)).split("== Physical Plan ==")[1]
    assert plan.index("Expand") < plan.rindex("HashAggregate(keys=[event_date")
