from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kpiloom.functions.exprs import shift_months
from kpiloom.operators import series


def test_shift_months_clamps_like_add_months():
    assert shift_months("2024-03-31", -1) == dt.date(2024, 2, 29)
    assert shift_months("2023-12-15", 1) == dt.date(2024, 1, 15)


def test_spine_fills_months_at_the_ends_and_inside(spark, frame):
    df = frame("id long, d date", (1, "2024-02-10"), (2, "2024-02-11"), (1, "2024-04-01"))
    metric = series.monthly_entities(df, "id", "d")
    filled = series.fill_on_spine(metric, series.month_spine(spark, "2024-01-15", "2024-05-02"), "metric_value")
    assert rows(filled) == [
        ("2024-01-01", 0), ("2024-02-01", 2), ("2024-03-01", 0), ("2024-04-01", 1), ("2024-05-01", 0)
    ]


def test_fill_months_per_key_over_a_range(frame):
    metric = frame(
        "k string, month date, v long",
        ("a", "2023-11-01", 9), ("a", "2024-02-01", 5), ("b", "2024-01-01", None),
        ("c", "2023-01-01", 1), ("d", "2024-06-01", 1), ("e", None, 3),
    )
    filled = rows(series.fill_months(metric, "k", "v", "2024-01-01", "2024-03-01"), "k", "month", "v")
    zero = {k: [(k, f"2024-0{m}-01", 0) for m in (1, 2, 3)] for k in "bcd"}
    assert filled == [
        ("a", "2024-01-01", 0), ("a", "2024-02-01", 5), ("a", "2024-03-01", 0),
        *zero["b"], *zero["c"], *zero["d"],
    ]


ROLLING = [(1, "2024-01-05", 1), (1, "2024-01-25", 2), (1, "2024-02-01", 4), (1, "2024-05-01", 8),
           (2, "2024-03-01", 5)]


def test_rolling_counts_active_months(frame):
    df = frame("id long, d date, v long", *ROLLING)
    result = rows(series.rolling(df, "id", "d", "v"), "id", "month", "monthly_value", "rolling_3m_sum", "rolling_3m_avg")
    assert result == [
        (1, "2024-01-01", 3, 3, 3.0), (1, "2024-02-01", 4, 7, 3.5), (1, "2024-05-01", 8, 15, 5.0),
        (2, "2024-03-01", 5, 5, 5.0),
    ]


def test_rolling_gap_filled_counts_calendar_months(frame):
    df = frame("id long, d date, v long", *ROLLING)
    result = rows(series.rolling(df, "id", "d", "v", gap_fill=True), "id", "month", "rolling_3m_sum")
    assert result == [
        (1, "2024-01-01", 3), (1, "2024-02-01", 7), (1, "2024-03-01", 7), (1, "2024-04-01", 4),
        (1, "2024-05-01", 8), (2, "2024-03-01", 5),
    ]


def test_rolling_range_ends_on_each_date(frame):
    df = frame(
        "d date, v long",
        ("2024-01-31", 1), ("2024-02-29", 2), ("2024-05-29", 4), ("2024-05-30", 8), ("2024-05-30", 1),
        ("2024-06-01", 16),
    )
    # three months before 30 May is the last day of February
    result = rows(series.rolling_range(df, "d", "v"), "as_of_date", "daily_value", "rolling_3m")
    assert result == [
        ("2024-01-31", 1, 1), ("2024-02-29", 2, 3), ("2024-05-29", 4, 6), ("2024-05-30", 9, 15),
        ("2024-06-01", 16, 29),
    ]


def test_rolling_new_starts_warmup(frame):
    df = frame(
        "provider_id long, product string, service_date date, new_start int",
        (1, "P", "2023-12-05", 1), (1, "P", "2024-01-05", 1), (1, "P", "2024-01-20", 1),
        (1, "P", "2024-03-31", 1), (1, "P", "2024-04-01", 1), (1, "Q", "2024-01-01", 1),
    )
    cold = series.rolling_new_starts(df, "P", "2024-01-01", "2024-03-31", months=3)
    warm = series.rolling_new_starts(df, "P", "2024-01-01", "2024-03-31", months=3, warmup=True)
    assert rows(cold, "month", "new_starts", "rolling_3m") == [("2024-01-01", 2, 2), ("2024-03-01", 1, 3)]
    assert rows(warm, "month", "new_starts", "rolling_3m") == [("2024-01-01", 2, 3), ("2024-03-01", 1, 4)]


def test_trend_uses_the_previous_month_with_data(frame):
    df = frame(
        "entity_id long, service_date date, paid_amount double",
        (1, "2023-05-31", 1), (1, "2023-06-01", 100), (2, "2023-06-30", 100), (1, "2023-08-01", 50),
        (1, "2024-06-15", 0), (1, "2024-06-16", 0),
    )
    trend = series.monthly_trend(df, "2024-06-20", months=12)
    picked = ["month", "total_paid", "unique_entities", "prior_month_paid", "mom_pct_change"]
    assert rows(trend, *picked) == [
        ("2023-06-01", 200.0, 2, None, None),
        ("2023-08-01", 50.0, 1, 200.0, -75.0),
        ("2024-06-01", 0.0, 1, 50.0, -100.0),
    ]
    past = series.monthly_trend(df, "2023-07-31", months=1)
    assert rows(past, "month", "total_paid") == [("2023-06-01", 200.0)]
    filled = series.monthly_trend(df, "2024-06-20", months=12, gap_fill=True)
    assert filled.count() == 13
    assert rows(filled.filter("month = '2023-09-01'"), *picked) == [("2023-09-01", 0.0, 0, 50.0, -100.0)]
    assert rows(filled.filter("month = '2023-10-01'"), *picked) == [("2023-10-01", 0.0, 0, 0.0, None)]


def test_yoy_keeps_entities_of_the_third_year(frame):
    df = frame(
        "id long, d date",
        (1, "2024-02-29"), (1, "2024-03-01"), (1, "2023-01-01"), (1, "2023-12-31"),
        (2, "2023-05-01"), (3, "2024-01-01"), (4, "2022-01-01"), (5, "2021-12-31"),
    )
    picked = ["id", "cy_count", "py_count", "yoy_abs_change", "yoy_pct_change"]
    assert rows(series.yoy(df, "id", "d", "2024-02-29"), *picked) == [
        (1, 1, 2, -1, -50.0), (2, 0, 1, -1, -100.0), (3, 1, 0, 1, None), (4, 0, 0, 0, None)
    ]
    aligned = series.yoy(df, "id", "d", "2024-02-29", ytd_aligned=True)
    assert rows(aligned, *picked)[0] == (1, 1, 1, 0, 0.0)


GROWTH = [
    (1, "2023-11-01", 1), (1, "2024-01-31", 1), (1, "2024-02-01", 3), (2, "2024-01-05", 2),
    (3, "2024-04-30", 4), (4, "2024-03-01", 0), (None, "2024-03-01", 7), (5, "2024-05-01", 9),
    (6, "2023-12-01", None),
]


def test_growth_keeps_one_sided_keys_and_guards_zero_bases(frame):
    df = frame("p long, d date, v int", *GROWTH)
    pre, post = ("2023-11-01", "2024-01-31"), ("2024-02-01", "2024-04-30")
    by_key = series.period_growth(df, "d", "v", pre, post, "p")
    assert rows(by_key) == [
        (1, 2, 3, 1, 50.0), (2, 2, 0, -2, -100.0), (3, 0, 4, 4, None), (4, 0, 0, 0, None),
        (6, 0, 0, 0, None),
    ]
    total = series.period_growth(df, "d", "v", pre, post)
    assert rows(total) == [(4, 14, 10, 250.0)]
    nothing = series.period_growth(df, "d", "v", pre, post, where=F.col("p") == 99)
    assert rows(nothing) == [(None, None, None, None)]


@pytest.mark.parametrize("last, truncated", [(79, 1), (80, 0), (81, 0)])
def test_truncation_compares_with_the_prior_month(frame, last, truncated):
    days = [("2024-01-01",)] * 50 + [("2024-02-02",)] * 200 + [("2024-03-03",)] * 100
    df = frame("d date", *days, *[("2024-04-04",)] * last)
    audit = {r[0]: r for r in rows(series.truncation_audit(df, "d"))}
    assert audit["2024-04-01"] == ("2024-04-01", last, last / 200, last / 100, truncated)
    assert audit["2024-03-01"][4] == 0
    assert series.truncation_audit(df, "d", last=2).count() == 2


def test_freshness(frame):
    df = frame("d timestamp", ("2024-01-01T00:00:00",), ("2024-01-31T23:00:00",), (None,))
    assert rows(series.freshness(df, "d", "2024-02-02")) == [("2024-01-31", 2)]


def test_goals_keep_both_sides_and_drop_unknown_keys(frame):
    df = frame(
        "id long, d timestamp, claim long",
        (1, "2024-01-05T00:00:00", 1), (1, "2024-01-06T00:00:00", 2), (1, "2024-02-01T00:00:00", 3),
        (None, "2024-01-01T00:00:00", 4), (2, "2024-01-01T00:00:00", 5),
    )
    actuals = series.monthly_actuals(df, "d", "id", F.count_distinct("claim"))
    goals = frame(
        "month date, id string, goal_value int",
        ("2024-01-01", "1", 4), ("2024-03-01", "1", 5), ("2024-01-01", "2", 0), ("2024-01-01", None, 1),
    )
    assert rows(series.actuals_vs_goals(actuals, goals, "id")) == [
        ("2024-01-01", "1", 2, 4, 2, 4, 50.0),
        ("2024-01-01", "2", 1, 0, 1, 0, None),
        ("2024-02-01", "1", 1, None, 1, 0, None),
        ("2024-03-01", "1", None, 5, 0, 5, 0.0),
    ]


def test_goals_keep_fractions(frame):
    actuals = frame("month date, id string, actual_value double", ("2024-01-01", "1", 10.9))
    goals = frame("month date, id string, goal_value double", ("2024-01-01", "1", 0.9))
    assert rows(series.actuals_vs_goals(actuals, goals, "id"), "actual_value", "goal_value", "pct_to_goal") == [
        (10.9, 0.9, 1211.1)
    ]
