"""Operators that split or place keys with many rows, against brute force."""

from __future__ import annotations

import datetime as dt
import bisect
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kpiloom.functions import ordered
from kpiloom.operators import entity, journey, threads
from kpiloom.sources import stage


def history(seed: int, size: int = 300) -> list[tuple]:
    """Fills of which entity 1 has a third, some without an entity or a date, many same-day."""
    pick = random.Random(seed)
    out = []
    for n in range(size):
        who = 1 if n % 3 == 0 else pick.choice([2, 3, 4, 5, None])
        day = dt.date(2024, 1, 1) + dt.timedelta(days=pick.choice(range(0, 200, 3)))
        day = None if pick.random() < 0.03 else day
        out.append((who, pick.choice("AB"), day, n, int(pick.random() < 0.2)))
    return out


SCHEMA = "entity_id long, product string, service_date date, n long, new_start int"


def grouped(data, key):
    groups: dict = {}
    for row in data:
        groups.setdefault(key(row), []).append(row)
    return groups.values()


def nulls_first(day):
    return (day is not None, day or dt.date.min)


@pytest.mark.parametrize("split", ["day", "order"])
@pytest.mark.parametrize("seed", [1, 60])
def test_fill_gaps_against_brute_force(spark, seed, split):
    data = history(seed)
    expected = []
    for group in grouped(data, lambda r: r[0]):
        prior = None
        for number, row in enumerate(sorted(group, key=lambda r: (*nulls_first(r[2]), r[3])), 1):
            days = (row[2] - prior).days if row[2] and prior else None
            if number == 1:
                status = "Index Fill"
            elif days is not None and days <= 45:
                status = "Continuous"
            elif days is not None and days <= 90:
                status = "Short Gap"
            else:
                status = "Lapse / Restart"
            expected.append((row[0], row[3], prior, days, number, status))
            prior = row[2]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = journey.fill_gaps(df, "entity_id", "service_date", "n", split=split).select(
        "entity_id", "n", "prior_fill_date", "days_since_prior_fill", "fill_number",
        "persistence_status",
    )
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(
        expected, key=lambda r: r[1]
    )


@pytest.mark.parametrize("split", ["day", "order"])
@pytest.mark.parametrize("seed", [2, 26])
def test_fill_episodes_against_brute_force(spark, seed, split):
    data = history(seed)
    expected = []
    dated = [r for r in data if r[2]]
    for group in grouped(dated, lambda r: r[:2]):
        in_order = sorted(group, key=lambda r: (r[2], r[3]))
        episodes, total = [], 0
        for row in in_order:
            total += row[4]
            episodes.append(total)
        for i, row in enumerate(in_order):
            following = in_order[i + 1][2] if i + 1 < len(in_order) else None
            first = min(o[2] for o, e in zip(in_order, episodes) if e == episodes[i])
            expected.append((row[3], following, episodes[i], first))
    df = spark.createDataFrame(data, SCHEMA).select(
        "*",
        F.col("n").alias("claim_id"),
        F.lit(1).alias("provider_id"),
        F.lit("300").alias("strength"),
        F.lit(2.0).alias("quantity"),
        F.lit(14).alias("days_supply"),
        F.lit(1980).alias("birth_year"),
    )
    got = journey.fill_episodes(df, "n", split=split).select(
        "n", "next_fill_date", "episode", "first_date"
    )
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def in_pieces(df, keys, order, pieces):
    split = ordered.split_in_order(df, keys, order, pieces)
    return split.rows.groupBy(*split.parts).count()


def test_pieces_follow_the_order_whatever_its_types(spark):
    pick = random.Random(5)
    data = [(n % 3, pick.choice([None, "", "a", "b"]), pick.choice([None, 1.5, -0.5]), n) for n in range(500)]
    df = spark.createDataFrame(data, "k int, s string, v double, n long").repartition(5)
    split = ordered.split_in_order(df, "k", ["s", "v", "n"], 16)
    got = [tuple(r) for r in split.rows.select("s", "v", "n", "__bucket").collect()]
    got.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0.0, r[2]))
    pieces = [r[3] for r in got]
    assert pieces == sorted(pieces) and set(pieces) == set(range(16))


def test_rows_carry_the_edges_of_one_node_at_a_time(spark):
    df = spark.range(20_000).selectExpr("cast(1 AS int) AS k", "nullif(id * 7919 % 20011, 5) AS n")
    pieces = 1500  # three digits
    edges = ordered.order_edges(df, "n", pieces)
    sorted_edges = [e.o0 for e in edges.first().edges]
    place = F.struct(F.col("n").alias("o0"))
    got = ordered.with_piece(df, edges, place, pieces).select("n", "__bucket")
    known = [e for e in sorted_edges if e is not None]
    for n, piece in got.collect():
        assert piece == len(sorted_edges) - len(known) + (0 if n is None else bisect.bisect_right(known, n))
    # no array of all edges beside the rows
    assert "__edges" not in ordered.split_in_order(df, "k", "n", pieces).rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("pieces", [1, 2, 7, 64])
def test_edges_of_few_rows(spark, pieces):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "k int, n int")
    got = in_pieces(df, "k", "n", pieces).agg(F.sum("count"), F.max("__bucket")).first()
    assert got[0] == 3 and got[1] < pieces
    assert in_pieces(df.limit(0), "k", "n", pieces).count() == 0


@pytest.fixture
def several_partitions(spark):
    """Keep the small partitions of the range sort apart."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.mark.parametrize("date", ["DATE '2024-05-05'", "CAST(NULL AS DATE)"])
def test_one_key_on_one_day_is_split_evenly(spark, several_partitions, date):
    rows_ = spark.range(60_000).selectExpr("1 AS entity_id", f"{date} AS service_date", "id * id AS n")
    fill = rows_.withColumn("service_date", F.expr(date))
    counts = [r["count"] for r in in_pieces(fill, "entity_id", ["service_date", "n"], 64).collect()]
    assert len(counts) == 64 and sum(counts) == 60_000
    assert max(counts) < 4 * 60_000 / 64

    # pieces of the default number, placed as the window places them
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    split = ordered.split_in_order(fill, "entity_id", ["service_date", "n"])
    tasks = split.rows.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    sizes = sorted(r["count"] for r in tasks)
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]

    gaps = journey.fill_gaps(fill, "entity_id", "service_date", "n", split="order")
    last = gaps.agg(F.max("fill_number"), F.count_distinct("fill_number"), F.max("days_since_prior_fill")).first()
    assert tuple(last)[:2] == (60_000, 60_000) and last[2] == (0 if "2024" in date else None)


def test_rank_all_against_brute_force(spark, several_partitions):
    pick = random.Random(3)
    data = [
        (n, None if pick.random() < 0.05 else float(pick.choice(range(12))), pick.choice(["a", "b", None]))
        for n in range(400)
    ]
    df = spark.createDataFrame(data, "id long, v double, s string").repartition(7)
    in_order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]), reverse=True)
    values = []
    for row in in_order:
        if row[1] not in values:
            values.append(row[1])
    seen: dict = {}
    expected = []
    for number, (id_, v, s) in enumerate(in_order, 1):
        seen[s] = seen.get(s, 0) + 1
        expected.append((id_, number, values.index(v) + 1, seen[s]))
    got = entity.rank_all(df, "id", "v", "s").select(
        "id", "overall_rank", "overall_rank_dense", "rank_within_segment"
    )
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_full_threads_with_a_hot_thread(spark):
    day = dt.datetime(2024, 1, 1)
    data = [(1 if n % 3 else n, n, day, "user", "s", "needle" if n == 4 else "hay") for n in range(30)]
    df = spark.createDataFrame(
        data, "thread_id long, seq long, ts timestamp, sender string, subject string, text string"
    )
    found = threads.thread_search(df, keywords=["NEEDLE"])
    assert rows(found, "seq") == sorted(((n,) for n in range(30) if n % 3), key=lambda r: str(r[0]))


def test_rank_all_leaves_nothing_behind(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "id long, v double, s string")
    path = f"{tmp_path}/copy"
    ranked = entity.rank_all(df, "id", "v", "s", path=path)
    assert rows(ranked, "id", "overall_rank") == [(1, 2), (2, 1)]
    stage.remove(spark, path)
    assert list(tmp_path.iterdir()) == []
