from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small frames: ``frame("id long, d date", (1, "2024-01-31"), ...)``; ISO text becomes dates."""

    def build(schema: str, *rows: tuple) -> DataFrame:
        fields = [part.split() for part in schema.split(", ")]

        def typed(value, kind):
            if value is None:
                return None
            if kind == "date":
                return dt.date.fromisoformat(value)
            if kind in ("timestamp", "timestamp_ntz"):
                return dt.datetime.fromisoformat(value)
            if kind == "double":
                return float(value)
            return value

        data = [tuple(typed(v, f[1]) for v, f in zip(row, fields)) for row in rows]
        return spark.createDataFrame(data, schema)

    return build


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """The rows as sorted tuples of the given columns; dates as ISO text."""
    picked = df.select(*columns) if columns else df
    out = [
        tuple(v.isoformat() if isinstance(v, dt.date) else v for v in row)
        for row in picked.collect()
    ]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])
