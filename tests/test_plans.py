"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from conftest import DATA

from kpiloom.plans.catalog import QUERIES
from kpiloom.sources import bindings


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df) -> str:
    """What has run; the plans of subqueries in it, which have initial plans as well, are indented."""
    return plan_of(df).split("\n+- == Initial Plan ==")[0]


@pytest.fixture
def no_small_tables(spark):
    """Plan as for tables too large to broadcast."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins_and_no_python(spark, no_small_tables, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert unwanted not in plan


def test_top_n_ranks_after_the_limit(spark):
    plan = plan_of(QUERIES["topn"](spark, DATA))
    assert "TakeOrderedAndProject" in plan
    assert not re.search(r"\bExchange ", plan)


def test_latest_per_key_limits_before_the_shuffle(spark):
    plan = plan_of(QUERIES["dedup_latest"](spark, DATA))
    before, after = plan.split("Exchange hashpartitioning", 1)
    assert "row_number(), 1, Final" in before
    assert "row_number(), 1, Partial" in after


@pytest.mark.parametrize(
    "name, most",
    [
        ("fill_gap", {"lineitem": 1, "orders": 1}),
        ("fill_episodes", {"lineitem": 1, "orders": 1, "part": 1}),
        ("thread_search", {"conversations": 3}),
        ("monthly_trend_by_region", {"orders": 1}),
        ("fixed_lod_avg", {"orders": 1}),
        ("kpi_run", {"orders": 3}),
        ("kpi_run_one_pass", {"orders": 1, "customer": 1}),
    ],
)
def test_tables_are_read_so_often_in_the_final_plan(spark, no_small_tables, name, most):
    result = QUERIES[name](spark, DATA)
    result.collect()
    final = final_plan_of(result)
    for table, times in most.items():
        assert len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", final)) <= times, table


@pytest.mark.parametrize("name", ["fill_gap", "fill_episodes", "fill_gap_one_day", "fill_episodes_one_day"])
def test_rows_are_shuffled_once_for_window_and_carry(spark, no_small_tables, name):
    result = QUERIES[name](spark, DATA)
    result.collect()
    final = final_plan_of(result)
    assert final.count("REPARTITION_BY_COL") == 2 and "ReusedExchange" in final


def test_lines_are_shuffled_once_by_their_key(spark, no_small_tables):
    plan = plan_of(QUERIES["bucket_classified"](spark, DATA))
    tagged = plan[: plan.index("Window")]
    assert tagged.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["rolling_6m", "period_growth_entity", "monthly_trend_mom", "yoy"])
def test_date_ranges_reach_the_scan(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert re.search(r"PushedFilters: \[[^\]]*(GreaterThanOrEqual|LessThan)\((l_shipdate|o_orderdate)", plan)


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(QUERIES["monthly_trend_mom"](spark, DATA))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_bindings_join_only_what_the_columns_need(spark):
    assert "Join" not in plan_of(bindings.fills(spark, DATA, "provider_id", "service_date"))
    assert plan_of(bindings.fills(spark, DATA, "provider_id", "product")).count("Join") == 1


def test_concordance_reads_the_lines_once(spark):
    result = QUERIES["concordance_market"](spark, DATA)
    result.collect()
    assert "ReusedExchange" in plan_of(result)


def test_lookups_do_not_widen_the_scan(spark):
    plan = plan_of(QUERIES["monthly_trend_by_region"](spark, DATA))
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan
