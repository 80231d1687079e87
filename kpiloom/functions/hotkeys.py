"""Windows over the rows of an entity of which one may hold a large part of all rows.

A window over one entity runs in one task. For an entity with a third of the table that is a task
that never ends. So all entities are split by calendar day, in one way at every size: rows are
placed by key and day, the window runs inside each (key, day), and what has to cross from one day to
the next is carried by a table with one row per key and day, made from the same exchange. Where one
key's single day may be too large, :mod:`kpiloom.functions.ordered` cuts the order itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exprs import Names, day_of, names

BUCKET = "__bucket"
NO_DAY = "0001-01-01"


def _never_null(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.col(column), F.lit(""))
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.col(column), F.lit(0).cast(kind))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@dataclass(frozen=True)
class DaySplit:
    """Rows with helper columns that place each of them in a window group.

    ``parts`` are NULL-free stand-ins for the keys (so that a plain equi-join matches NULL
    keys as well) followed by the day. ``rows`` are shuffled by them once.
    """

    rows: DataFrame
    parts: list[str]

    def window(self, *order: str | Column) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*order)

    def whole(self, first: str) -> Column:
        """A row as a struct that begins with ``first``: as it has every column, an aggregate
        of it reads the same exchange as the window does."""
        others = [c for c in self.rows.columns if c != first and c not in self.parts]
        return F.struct(first, *others)

    def per_day(self, *aggregates: Column) -> DataFrame:
        """One row per key and day."""
        return self.rows.groupBy(*self.parts).agg(*aggregates)

    def along_days(self) -> WindowSpec:
        """Order over the days of one key; as long as the calendar, not as the table."""
        return Window.partitionBy(*self.parts[:-1]).orderBy(BUCKET)

    def attach(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        """Join the carried values to the rows.

        The join keys are the window's partition keys, so the rows are not shuffled again.
        """
        return rows.join(carried, self.parts, "left").drop(*self.parts)


def stand_ins(df: DataFrame, keys: Names) -> tuple[DataFrame, list[str]]:
    """The rows with NULL-free stand-ins for the keys, and the names of these."""
    keys = names(keys)
    values = [f"__key{i}" for i in range(len(keys))]
    nulls = [f"__null{i}" for i in range(len(keys))]
    tagged = df.select(
        "*",
        *[_never_null(df, k).alias(s) for k, s in zip(keys, values)],
        *[F.col(k).isNull().alias(n) for k, n in zip(keys, nulls)],
    )
    return tagged, [*values, *nulls]


def split_by_day(df: DataFrame, keys: Names, date: str) -> DaySplit:
    tagged, parts = stand_ins(df, keys)
    tagged = tagged.withColumn(BUCKET, F.coalesce(day_of(date), F.lit(NO_DAY).cast("date")))
    parts = [*parts, BUCKET]
    return DaySplit(tagged.repartition(*parts), parts)
