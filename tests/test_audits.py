"""Counts kept for each file, against a full recount."""

from __future__ import annotations

import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kpiloom.operators import audits, series


def part(spark, seed, months, size=200):
    pick = random.Random(seed)
    data = [
        (n, None if pick.random() < 0.05 else f"2024-{pick.choice(months):02}-{pick.randint(1, 28):02}")
        for n in range(size)
    ]
    return spark.createDataFrame(data, "n long, d string").withColumn("d", F.to_date("d"))


@pytest.fixture
def table(spark, tmp_path):
    path, store = f"{tmp_path}/a t+b%20c", f"{tmp_path}/counts"
    part(spark, 1, [1, 2, 3]).repartition(3).write.parquet(path)
    return path, store


def same_as_recount(spark, path, store):
    everything = spark.read.parquet(path)
    assert rows(audits.audit_files(spark, path, store, "d")) == rows(series.truncation_audit(everything, "d"))
    assert rows(audits.freshness_of_files(spark, path, store, "d", "2024-12-31")) == rows(
        series.freshness(everything, "d", "2024-12-31")
    )
    got = audits.current_counts(spark, path, store)
    assert got.agg(F.sum("row_count")).first()[0] == everything.count()


def test_only_new_files_are_read(spark, table):
    path, store = table
    assert audits.uncounted_files(spark, path, store).count() == 3
    assert audits.update_counts(spark, path, store, "d") == 3
    assert audits.update_counts(spark, path, store, "d") == 0
    same_as_recount(spark, path, store)
    part(spark, 2, [3, 4]).repartition(2).write.mode("append").parquet(path)
    assert audits.update_counts(spark, path, store, "d") == 2
    same_as_recount(spark, path, store)


def test_removed_replaced_and_doubly_counted_files(spark, table):
    path, store = table
    audits.update_counts(spark, path, store, "d")
    first, second, _ = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.remove(f"{path}/{first}")
    # the same name with other rows, as of another time
    part(spark, 3, [5], 77).coalesce(1).write.parquet(f"{path}.other")
    (other,) = (f for f in os.listdir(f"{path}.other") if f.endswith(".parquet"))
    with open(f"{path}.other/{other}", "rb") as source, open(f"{path}/{second}", "wb") as target:
        target.write(source.read())
    for name in (first, second):
        if os.path.exists(f"{path}/.{name}.crc"):
            os.remove(f"{path}/.{name}.crc")
    os.utime(f"{path}/{second}", (2_000_000_000, 2_000_000_000))
    assert audits.update_counts(spark, path, store, "d") == 1
    again = audits.stored_counts(spark, store).collect()
    spark.createDataFrame(again, audits.STORE_SCHEMA).write.mode("append").parquet(store)
    same_as_recount(spark, path, store)


def test_files_without_rows_and_partitioned_tables(spark, tmp_path):
    path, store = f"{tmp_path}/t", f"{tmp_path}/counts"
    part(spark, 4, [1]).limit(0).coalesce(1).write.parquet(path)
    found = audits.list_files(spark, path).count()
    assert audits.update_counts(spark, path, store, "d") == found
    assert audits.update_counts(spark, path, store, "d") == 0
    assert rows(audits.current_counts(spark, path, store)) == []
    assert rows(audits.audit_files(spark, path, store, "d")) == []

    path, store = f"{tmp_path}/by_day", f"{tmp_path}/more"
    part(spark, 5, [2, 3], 60).filter("day(d) < 5").coalesce(1).write.partitionBy("d").parquet(path)
    assert audits.update_counts(spark, path, store, "d") > 1
    same_as_recount(spark, path, store)


def test_a_single_file(spark, table):
    path, store = table
    one = next(f"{path}/{f}" for f in sorted(os.listdir(path)) if f.endswith(".parquet"))
    same_as_recount(spark, one, store)
