"""The catalog on skewed tables: one customer, order, part, supplier, user and thread each hold a third."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from compare import connect, differences, oracle_table
from conftest import DATA

from kpiloom.plans.catalog import QUERIES
from kpiloom.plans.oracle import ORACLE_SQL

HOT = {
    "orders": {"o_custkey": 7},
    "lineitem": {"l_orderkey": 5, "l_partkey": 3, "l_suppkey": 2},
    "events": {"user_id": 7},
}
ROW = {"orders": "o_orderkey", "lineitem": "l_orderkey + l_linenumber", "events": "event_id"}

AFFECTED = """
dedup_latest rolling_3m_gap_filled cohort_retention fill_gap fill_gap_by_day actuals_vs_goals topn_full
entity_summary monthly_trend_by_region top_cost call_funnel_ordered fixed_lod_avg bucket_priority
concordance_market stage_3bucket fill_episodes dosing_consolidated market_flags overlap_recent join_fanout
join_cardinality kpi_missing thread_search thread_latest
""".split()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        replaced = [
            f"CASE WHEN ({ROW[name]}) % 3 = 0 THEN {value} ELSE {column} END AS {column}"
            for column, value in HOT.get(name, {}).items()
        ]
        if name == "conversations":
            # turns stay unique within the large thread
            replaced = [
                "CASE WHEN conv_id % 3 = 0 THEN 2 ELSE conv_id END AS conv_id",
                "CASE WHEN conv_id % 3 = 0 THEN conv_id * 10 + turn + 100 ELSE turn END AS turn",
            ]
        star = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
        connection.execute(
            f"COPY (SELECT {star} FROM '{path}') TO '{folder}/{name}.parquet' (FORMAT parquet)"
        )
    return folder


@pytest.fixture(scope="module")
def duck(skewed):
    return connect(skewed)


@pytest.mark.parametrize("name", AFFECTED)
def test_query_matches_sql_on_skewed_tables(spark, skewed, duck, name):
    result = QUERIES[name](spark, skewed).toArrow()
    assert result.num_rows > 0
    assert differences(result, oracle_table(duck, ORACLE_SQL[name])) == []
