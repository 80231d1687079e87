"""Comparison of a Spark result with the SQL that defines it, run by DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pyarrow as pa


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def oracle_table(connection: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    return connection.sql(sql).to_arrow_table()


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_large_string(kind) or pa.types.is_string(kind):
        return "string"
    return str(kind)


def _key(row: tuple) -> list:
    return [(value is None, str(value)) for value in row]


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(spark_table: pa.Table, oracle_table: pa.Table) -> list[str]:
    """What differs: column names, types, row count or, in row order independent form, values."""
    columns = sorted(spark_table.column_names)
    if columns != sorted(oracle_table.column_names):
        return [f"columns {columns} vs {sorted(oracle_table.column_names)}"]
    found = []
    for name in columns:
        a, b = (_kind(t.schema.field(name).type) for t in (spark_table, oracle_table))
        if a != b:
            found.append(f"type of {name}: {a} vs {b}")
    if spark_table.num_rows != oracle_table.num_rows:
        return [*found, f"rows {spark_table.num_rows} vs {oracle_table.num_rows}"]
    sides = [
        sorted(zip(*[t.column(name).to_pylist() for name in columns]), key=_key)
        for t in (spark_table, oracle_table)
    ]
    differing = [
        (a, b)
        for a, b in zip(*sides)
        if not all(_same(x, y) for x, y in zip(a, b))
    ]
    if differing:
        found.append(f"{len(differing)} rows differ, first: {columns} {differing[0]}")
    return found
