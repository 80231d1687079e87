from __future__ import annotations

import random

import pytest
from conftest import DATA, rows

from kpiloom.operators import profiles, quality
from kpiloom.sources import bindings


def table(spark, count=3000):
    rng = random.Random(6)
    data = [
        (i, rng.choice((None, -5, 7, 10**12)), rng.gauss(0, 1e6), rng.choice("äbc") * rng.randrange(1, 4), f"2024-0{rng.randrange(1, 9)}-01")
        for i in range(count)
    ]
    df = spark.createDataFrame(data, "id int, some long, x double, s string, d string")
    return df.selectExpr("*", "cast(d AS date) AS day", "cast(x AS decimal(20, 3)) AS money", "array(id) AS list", "s = 'b' AS flag")


def test_merged_halves_are_the_whole(spark):
    df = table(spark)
    whole = profiles.profile_report(profiles.profile_sketches(df)).orderBy("position").collect()
    halves = [profiles.profile_sketches(df.where(f"id % 2 = {i}")) for i in (0, 1)]
    merged = profiles.profile_report(profiles.merge_profiles(*halves)).orderBy("position").collect()
    parts = profiles.profile_sketches(df.withColumn("p", df["id"] % 3), by="p")
    grouped = profiles.profile_report(profiles.merge_profiles(parts)).orderBy("position").collect()
    for one, other, third in zip(whole, merged, grouped, strict=True):
        assert one[:5] == other[:5] == third[:5] and one[6:8] == other[6:8] == third[6:8]
        if one.distinct_estimate is not None:
            assert abs(one.distinct_estimate - other.distinct_estimate) <= 0.03 * one.distinct_estimate


def test_estimates_are_within_their_bounds(spark):
    df = table(spark)
    halves = [profiles.profile_sketches(df.where(f"id < 1000 {op}")) for op in ("", "AND false OR id >= 1000")]
    report = {r.column_name: r for r in profiles.profile_report(profiles.merge_profiles(*halves)).collect()}
    exact = {r.column_name: r for r in quality.profile_table(df.drop("list")).collect()}
    for name, r in exact.items():
        got = report[name]
        assert (got.row_count, got.null_count, got.min_value, got.max_value) == (r.row_count, r.null_count, r.min_value, r.max_value), name
        assert abs(got.distinct_estimate - r.distinct_count) <= 0.04 * r.distinct_count
    assert report["list"].row_count == 3000 and report["list"].distinct_estimate is None
    for name in ("id", "x", "money"):
        values = sorted(float(r[0]) for r in df.select(name).collect())
        for share, value in zip((0.25, 0.5, 0.75), report[name].quantiles):
            rank = sum(v <= value for v in values) / len(values)
            assert abs(rank - share) < 0.02
    assert report["s"].quantiles == [None, None, None]


def test_one_pass(spark):
    plan = profiles.profile_sketches(bindings.table(spark, DATA, "orders"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Expand") == 0


def test_unknown_and_empty(frame):
    df = frame("n long, t string", (None, None), (None, "b"))
    empty = profiles.profile_sketches(df.limit(0))
    merged = profiles.merge_profiles(profiles.profile_sketches(df), empty)
    assert rows(profiles.profile_report(merged).drop("quantiles")) == [
        (0, "n", "bigint", 2, 2, 0, None, None), (1, "t", "string", 2, 1, 1, "b", "b")
    ]
    assert rows(profiles.profile_report(empty), "row_count", "distinct_estimate") == [(0, 0), (0, 0)]
    with pytest.raises(ValueError, match="missing"):
        profiles.profile_sketches(df, by="nope")
