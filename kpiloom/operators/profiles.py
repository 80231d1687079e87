"""Mergeable table profiles: stored sketches that add up without reading the rows again.

A profile is one row per column (and part of the table): counts, range, a sketch of the different
values and, for numbers, a sketch of the quantiles. New rows get a profile of their own, which is merged
with the stored one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exprs import Names, names, require_columns

#: Logarithm of the size of the sketches of different values: a relative standard deviation of 0.8 %.
DISTINCT_LOG = 14
#: Size of the quantile sketches: ranks within 0.7 % of the rows, for 99 of 100 sketches.
QUANTILE_SIZE = 400

#: Types whose text is an exact number.
WHOLE = "^(tinyint|smallint|int|bigint|decimal.*)$"

MEASURES = ["position", "column_name", "data_type"]


def _text_of_extreme(value: str, kind: Column, best: str) -> Column:
    """The least or largest of values kept as text, in the order of their type."""
    by = F.min_by if best == "min" else F.max_by
    number = F.when(kind.isin("float", "double"), F.expr(f"try_cast({value} AS double)"))
    whole = F.when(kind.rlike(WHOLE), F.expr(f"try_cast({value} AS decimal(38, 18))"))
    plain = F.when(number.isNull() & whole.isNull(), F.col(value))
    return by(value, F.when(F.col(value).isNotNull(), F.struct(number, whole, plain))).alias(value)


def profile_sketches(df: DataFrame, by: Names = ()) -> DataFrame:
    """One row per column, and per value of ``by`` if given; one pass over the table.

    ``row_count``, ``known_count``, ``min_value``, ``max_value`` (as text), ``distinct_sketch``,
    ``quantile_sketch`` (numbers only). Columns of nested types have counts only.
    """
    parts = names(by)
    require_columns(df, parts)
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in parts]
    aggregates, lines = [F.count(F.lit(1)).alias("__rows")], []
    for i, field in fields:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        plain = isinstance(kind, T.AtomicType) and not isinstance(kind, T.BinaryType)
        number = isinstance(kind, T.NumericType)
        aggregates.append(F.count(value).alias(f"__known{i}"))
        if plain:
            same = value.cast("long") if isinstance(kind, T.IntegralType) else value.cast("string")
            aggregates += [
                F.min(value).cast("string").alias(f"__min{i}"),
                F.max(value).cast("string").alias(f"__max{i}"),
                F.hll_sketch_agg(same, DISTINCT_LOG).alias(f"__distinct{i}"),
            ]
        if number:
            aggregates.append(F.kll_sketch_agg_double(value.cast("double"), QUANTILE_SIZE).alias(f"__quantiles{i}"))
        none = {c: F.lit(None).cast(c) for c in ("string", "binary")}
        lines.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(kind.simpleString()).alias("data_type"),
                F.col("__rows").alias("row_count"),
                F.col(f"__known{i}").alias("known_count"),
                (F.col(f"__min{i}") if plain else none["string"]).alias("min_value"),
                (F.col(f"__max{i}") if plain else none["string"]).alias("max_value"),
                (F.col(f"__distinct{i}") if plain else none["binary"]).alias("distinct_sketch"),
                (F.col(f"__quantiles{i}") if number else none["binary"]).alias("quantile_sketch"),
            )
        )
    return df.groupBy(*parts).agg(*aggregates).select(*parts, F.inline(F.array(*lines)))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all rows of which these (and their parts) are profiles."""
    columns = [*MEASURES, "row_count", "known_count", "min_value", "max_value", "distinct_sketch", "quantile_sketch"]
    rows = profiles[0].select(*columns)
    for other in profiles[1:]:
        rows = rows.unionByName(other.select(*columns))
    kind = F.col("data_type")
    # a sketch of no value has no quantiles to merge
    quantiles = F.when(F.col("known_count") > 0, F.col("quantile_sketch"))
    rows = rows.withColumn("quantile_sketch", quantiles)
    return rows.groupBy(*MEASURES).agg(
        F.sum("row_count").alias("row_count"),
        F.sum("known_count").alias("known_count"),
        _text_of_extreme("min_value", kind, "min"),
        _text_of_extreme("max_value", kind, "max"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def profile_report(profile: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A profile's numbers: rows, unknown values, estimated different values, range, estimated quantiles."""

    def quantile(share: float) -> Column:
        # merging no sketch at all gives an empty one
        number = F.col("data_type").rlike(WHOLE) | F.col("data_type").isin("float", "double")
        some = (F.col("known_count") > 0) & number
        return F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(share))))

    # columns without a sketch have values, but no estimate
    estimate = F.hll_sketch_estimate("distinct_sketch")
    return profile.select(
        *MEASURES,
        "row_count",
        (F.col("row_count") - F.col("known_count")).alias("null_count"),
        F.when((estimate > 0) | (F.col("known_count") == 0), estimate).alias("distinct_estimate"),
        "min_value",
        "max_value",
        F.array(*map(quantile, quantiles)).alias("quantiles"),
    )
