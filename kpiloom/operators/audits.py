"""Month counts kept for each file of a table, so that an audit after an append reads the new files only.

The store is a Parquet folder with one row per file, state of the file and month. It only grows by appends: rows
of files that were replaced or removed stay in it, and are left out where the files are listed. A count
that was written twice, by two updates at a time or by one that was repeated, counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.exprs import DateLike, day_of, month_of, or_zero, require_columns
from kpiloom.operators.series import freshness, truncation_of_counts

STORE_SCHEMA = (
    "file string, modified timestamp, size long, month date, row_count long, first_date date, last_date date"
)
STATE = ["file", "modified", "size"]


def _is(spark: SparkSession, path: str, what: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(place.getFileSystem(spark._jsc.hadoopConfiguration()), what)(place)


def _name(path: Column) -> Column:
    """One spelling for a file's name: ``file:///a`` and ``file:/a`` are the same file."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):///", "$1:/")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet table with time and size, without opening any: ``file``, ``modified``, ``size``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(
        _name(F.col("path")).alias("file"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("size"),
    )


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """All that has been counted; empty where nothing has."""
    if not _is(spark, store, "exists"):
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(store)


def uncounted_files(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Files of the table that the store does not know in their present state."""
    known = stored_counts(spark, store).select(*STATE).distinct()
    return list_files(spark, path).join(known, STATE, "left_anti")


def count_files(df: DataFrame, date: str) -> DataFrame:
    """Rows, first and last day for each file and month of a table read from files.

    Rows without a date count under an unknown month.
    """
    require_columns(df, date)
    # the metadata column has the name as in an address, a listing has it as it is
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = df.select(_name(plain).alias("file"), day_of(date).alias("day"))
    return rows.groupBy("file", month_of("day").alias("month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("day").alias("first_date"), F.max("day").alias("last_date")
    )


def update_counts(spark: SparkSession, path: str, store: str, date: str) -> int:
    """Count the files that the store does not know yet and append them; returns how many were read.

    The names of these files come to the driver, which lists them for their scan in any case. A file keeps the
    state it had when it was listed: if it is replaced before it is read, the next update reads it again. A file
    without rows is known by a line without a month.
    """
    new = uncounted_files(spark, path, store).collect()
    if not new:
        return 0
    reader = spark.read.option("basePath", path) if _is(spark, path, "isDirectory") else spark.read
    counted = count_files(reader.parquet(*[row["file"] for row in new]), date)
    listed = spark.createDataFrame(new, "file string, modified timestamp, size long")
    lines = listed.join(counted, "file", "left").withColumn("row_count", or_zero("row_count"))
    lines.select(*spark.createDataFrame([], STORE_SCHEMA).columns).write.mode("append").parquet(store)
    return len(new)


def current_counts(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Rows, first and last day for each month of the table, from the store alone.

    Only files count that the table has now, in the state that was counted.
    """
    known = stored_counts(spark, store).dropDuplicates([*STATE, "month"])
    return (
        known.join(list_files(spark, path), STATE, "left_semi")
        .filter("row_count > 0")
        .groupBy("month")
        .agg(
            F.sum("row_count").alias("row_count"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )


def audit_files(
    spark: SparkSession, path: str, store: str, date: str, threshold: float = 0.8, last: int = 6
) -> DataFrame:
    """:func:`kpiloom.operators.series.truncation_audit` of a Parquet table; runs :func:`update_counts` first."""
    update_counts(spark, path, store, date)
    monthly = current_counts(spark, path, store).select("month", "row_count")
    return truncation_of_counts(monthly, threshold, last)


def freshness_of_files(
    spark: SparkSession, path: str, store: str, date: str, as_of: DateLike | None = None
) -> DataFrame:
    """:func:`kpiloom.operators.series.freshness` of a Parquet table; runs :func:`update_counts` first."""
    update_counts(spark, path, store, date)
    return freshness(current_counts(spark, path, store), "last_date", as_of)
