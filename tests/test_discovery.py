from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kpiloom.operators import discovery


def test_grain_is_minimal_and_exact(spark):
    rng = random.Random(4)
    data = [(i // 3, i % 3, rng.randrange(500), "x", None if i == 5 else i) for i in range(900)]
    df = spark.createDataFrame(data, "a int, b int, c int, d string, e int")
    found = {r.grain: (r.width, r.total_rows) for r in discovery.grain_discover(df).collect()}
    want = {}
    for width in (1, 2, 3):
        for s in combinations(range(5), width):
            grain = ", ".join("abcde"[i] for i in s)
            if len({tuple(r[i] for i in s) for r in data}) == 900 and not any(set(k.split(", ")) < set(grain.split(", ")) for k in want):
                want[grain] = (width, 900)
    assert found == want and {"e", "a, b"} <= set(found)


def test_grain_with_one_repeat_outside_the_slice_is_found(spark):
    for repeated in (3, 77):
        df = spark.createDataFrame([(i,) for i in [*range(2000), repeated]], "k int")
        assert discovery.grain_discover(df).collect() == []


@pytest.mark.parametrize("slices, slice_rows, together", [(1, 1 << 20, 64), (64, 10, 3)])
def test_grain_for_any_slices(spark, monkeypatch, slices, slice_rows, together):
    monkeypatch.setattr(discovery, "SLICES", slices)
    monkeypatch.setattr(discovery, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(discovery, "TOGETHER", together)
    rng = random.Random(5)
    data = [(i // 20, *(rng.choice([None, *range(19)]) for _ in range(2)), i % 20 or None, rng.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(data, "a int, b int, c int, d int, e string")
    want = []
    for width in (1, 2, 3):
        for s in combinations(range(5), width):
            if len({tuple(r[i] for i in s) for r in data}) == 400 and not any(set(k) < set(s) for k in want):
                want.append(s)
    found = {r.grain for r in discovery.grain_discover(df).collect()}
    assert found == {", ".join("abcde"[i] for i in s) for s in want} and "a, d" in found


def test_grain_sketches_no_set_that_a_slice_refutes(spark, monkeypatch):
    """Sketches of all sets of three columns took most of the time."""
    sketched = []
    plain = discovery._estimates
    monkeypatch.setattr(discovery, "_estimates", lambda df, sets: sketched.extend(sets) or plain(df, sets))
    columns = [f"CAST(pmod(xxhash64(id, {i}), 500) AS int) AS {c}" for i, c in enumerate("abcd")]
    df = spark.range(20_000).selectExpr("CAST(id AS int) AS k", *columns)
    assert [r.grain for r in discovery.grain_discover(df.unionByName(df).withColumn("h", F.rand(1) < 0.5)).collect()] == []
    assert [s for s in sketched if len(s) > 1] == []


def test_grain_of_few_rows(frame):
    assert rows(discovery.grain_discover(frame("a long, b long", (1, None)))) == [("a", 1, 1), ("b", 1, 1)]
    assert rows(discovery.grain_discover(frame("a long, b long", (None, None), (None, 1)))) == [("b", 1, 2)]
    assert rows(discovery.grain_discover(frame("a long, b long", (None, 5), (5, None), (5, 5)))) == [("a, b", 2, 3)]
    assert rows(discovery.grain_discover(frame("a long").limit(0))) == []
    assert rows(discovery.grain_discover(frame("a long, b long", (1, 1), (1, 1)))) == []
    with pytest.raises(ValueError, match="missing"):
        discovery.grain_discover(frame("a long", (1,)), ["nope"])


def test_join_keys_by_values_not_by_names(spark):
    left = spark.createDataFrame(
        [(i % 40, f"n{i % 7}", float(i), i if i % 2 else None) for i in range(200)], "ref long, name string, x double, odd int"
    )
    right = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(50)], "id int, title string, third int")
    got = {(r.left_column, r.right_column): r for r in discovery.join_keys(left, right).collect()}
    assert set(got) == {("ref", "id"), ("name", "title")}
    assert got["ref", "id"].right_is_unique == 1 and got["ref", "id"].left_distinct == 40
    some = {(r.left_column, r.right_column): r.containment for r in discovery.join_keys(left, right, 0.05).collect()}
    assert some == {("ref", "id"): 1.0, ("ref", "third"): 3 / 40, ("name", "title"): 1.0, ("odd", "id"): 25 / 100}


def test_join_keys_of_nothing(frame):
    empty, full = frame("a long").limit(0), frame("b long, x double", (1, 1.0))
    for left, right in ((empty, full), (full, empty), (full.select("x"), full)):
        assert discovery.join_keys(left, right).collect() == []
    unknown = frame("a long", (None,))
    assert discovery.join_keys(unknown, full).collect() == []


@pytest.mark.parametrize("buckets", [1 << 16, 8, 1])
def test_heavy_keys_are_the_exact_first(spark, buckets):
    rng = random.Random(3)
    keys = [int(400 * rng.random() ** 5) for _ in range(6000)] + [7] * 3000 + [None] * 500
    data = [(k, k % 2 if k is not None else 0) for k in keys]
    df = spark.createDataFrame(data, "k long, half long").repartition(5)
    counts = Counter(k for k in keys if k is not None)
    for top in (1, 10, 1000):
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]
        got = discovery.heavy_keys(df, "k", top, buckets).collect()
        assert [(r.k, r.rows) for r in got] == want
        assert got[0].share == want[0][1] / 9000
    got = discovery.heavy_keys(df, ["half", "k"], 3, buckets).collect()
    assert [(r.k, r.rows) for r in got] == sorted(counts.items(), key=lambda x: (-x[1], x[0] % 2, x[0]))[:3]
    assert discovery.heavy_keys(df.limit(0), "k").collect() == []


def test_heavy_keys_count_few_keys_exactly(spark):
    """On a skewed table only keys of heavy buckets reach the exact count."""
    df = spark.range(200_000).selectExpr("IF(id % 3 = 0, -1, IF(id % 5 = 0, id % 50, id)) AS k")
    result = discovery.heavy_keys(df, "k", top=10)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "CartesianProduct" not in plan
    assert result.first().k == -1 and result.first().rows == 66_667
