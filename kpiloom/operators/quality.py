"""Checks that keep the numbers honest: fan-out, grain, joins, profiles, exclusivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import Names, any_of, names, or_zero, ratio, require_columns


def _count_rows() -> Column:
    return F.count(F.lit(1))


def fanout_check(df: DataFrame, id: Names, approx: bool = False) -> DataFrame:
    """Rows, distinct entities and rows without an entity, as one row.

    After a deduplication or a join that keeps one row per entity, the first two are equal.
    """
    keys = names(id)
    require_columns(df, keys)
    unknown = any_of(F.col(k).isNull() for k in keys)
    if approx:
        entities = F.approx_count_distinct(F.when(~unknown, F.struct(*keys)))
    else:
        entities = F.count_distinct(*keys)
    return df.agg(
        _count_rows().alias("total_rows"),
        entities.alias("distinct_entities"),
        F.count_if(unknown).alias("unknown_rows"),
    )


def fanout_offenders(df: DataFrame, id: Names) -> DataFrame:
    """The keys with more than one row, and how many they have."""
    require_columns(df, id)
    counts = df.groupBy(*names(id)).agg(_count_rows().alias("rows"))
    return counts.filter("rows > 1")


def join_fanout(before: DataFrame, after: DataFrame, id: Names) -> DataFrame:
    """Rows and entities on both sides of a join, and the factor by which rows grew."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return fanout_check(df, id).select(
            F.lit(name).alias("side"), "total_rows", "distinct_entities"
        )

    both = side(before, "before").unionByName(side(after, "after"))

    def value(column: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(column))).alias(f"{column}_{name}")

    measured = both.agg(
        *[value(c, s) for c in ("total_rows", "distinct_entities") for s in ("before", "after")]
    )
    growth = ratio(F.col("total_rows_after"), F.col("total_rows_before"))
    return measured.withColumn("row_multiplier", growth)


def profile_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, rows, NULLs, distinct values, smallest and largest as text.

    Two aggregations over all columns at once, each unpivoted from its single result row.
    Exact distinct counts shuffle each column's distinct values; ``approx`` replaces them by
    one sketch per task.
    """
    distinct = F.approx_count_distinct if approx else F.count_distinct
    columns = [(i, f.name, f.dataType.simpleString(), F.col(f"`{f.name}`"))
               for i, f in enumerate(df.schema.fields)]

    ranges = df.agg(
        _count_rows().alias("__rows"),
        *[F.count(c).alias(f"__known{i}") for i, _, _, c in columns],
        *[F.min(c).cast("string").alias(f"__min{i}") for i, _, _, c in columns],
        *[F.max(c).cast("string").alias(f"__max{i}") for i, _, _, c in columns],
    )
    range_lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col("__rows").alias("row_count"),
            (F.col("__rows") - F.col(f"__known{i}")).alias("null_count"),
            F.col(f"__min{i}").alias("min_value"),
            F.col(f"__max{i}").alias("max_value"),
        )
        for i, name, kind, _ in columns
    ]
    counts = df.agg(*[distinct(c).alias(f"__distinct{i}") for i, _, _, c in columns])
    count_lines = [
        F.struct(F.lit(i).alias("position"), F.col(f"__distinct{i}").alias("distinct_count"))
        for i, _, _, _ in columns
    ]
    return (
        ranges.select(F.inline(F.array(*range_lines)))
        .join(counts.select(F.inline(F.array(*count_lines))), "position")
        .select(
            *["position", "column_name", "data_type", "row_count", "null_count"],
            *["distinct_count", "min_value", "max_value"],
        )
    )


def grain_check(df: DataFrame, candidates: Sequence[Names]) -> DataFrame:
    """For each candidate key: distinct keys, repeated keys, most rows of one key, is it unique.

    One aggregation per candidate; the results are one row each.
    """
    checks = None
    for candidate in candidates:
        keys = names(candidate)
        require_columns(df, keys)
        counts = df.groupBy(*keys).agg(_count_rows().alias("rows"))
        measured = counts.agg(
            or_zero(F.sum("rows")).alias("total_rows"),
            _count_rows().alias("distinct_keys"),
            F.count_if(F.col("rows") > 1).alias("repeated_keys"),
            or_zero(F.max("rows")).alias("max_rows_per_key"),
        )
        check = measured.select(
            F.lit(", ".join(keys)).alias("candidate_key"),
            "*",
            F.when(F.col("repeated_keys") == 0, 1).otherwise(0).alias("is_unique"),
        )
        checks = check if checks is None else checks.unionByName(check)
    if checks is None:
        raise ValueError("no candidate keys given")
    return checks


# as wide as a sum of products of row counts can be stored
WIDE = "decimal(38,0)"

# fixed values: names of the join shapes
ONE_TO_ONE, ONE_TO_MANY, MANY_TO_ONE, MANY_TO_MANY = "1:1", "1:N", "N:1", "N:M"


def join_cardinality(left: DataFrame, right: DataFrame, keys: Names) -> DataFrame:
    """Shape and size of an inner join, unmatched keys and rows, without doing the join.

    Both sides are reduced to one row per key; a key's joined rows are the product of its
    counts, a decimal without fraction, as two hot keys go past a long. Unknown keys never match.
    """
    on = names(keys)
    require_columns(left, on)
    require_columns(right, on)
    counts = (
        left.groupBy(*on)
        .agg(_count_rows().alias("l"))
        .join(right.groupBy(*on).agg(_count_rows().alias("r")), on, "full_outer")
    )
    in_left, in_right = F.col("l").isNotNull(), F.col("r").isNotNull()
    both = in_left & in_right
    product = (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast(WIDE)
    summary = counts.agg(
        or_zero(F.sum("l")).alias("left_rows"),
        or_zero(F.sum("r")).alias("right_rows"),
        F.count_if(both).alias("matched_keys"),
        F.count_if(in_left & ~in_right).alias("left_only_keys"),
        F.count_if(in_right & ~in_left).alias("right_only_keys"),
        or_zero(F.sum(F.when(~in_right, F.col("l")))).alias("left_unmatched_rows"),
        or_zero(F.sum(F.when(~in_left, F.col("r")))).alias("right_unmatched_rows"),
        F.coalesce(F.sum(product), F.lit(0).cast(WIDE)).cast(WIDE).alias("joined_rows"),
        or_zero(F.max(F.when(both, F.col("l")))).alias("max_left_rows_per_key"),
        or_zero(F.max(F.when(both, F.col("r")))).alias("max_right_rows_per_key"),
    )
    many_left, many_right = F.col("max_left_rows_per_key") > 1, F.col("max_right_rows_per_key") > 1
    return summary.withColumn(
        "cardinality",
        F.when(many_left & many_right, MANY_TO_MANY)
        .when(many_left, MANY_TO_ONE)
        .when(many_right, ONE_TO_MANY)
        .otherwise(ONE_TO_ONE),
    )


def segment_counts(df: DataFrame, segment: str) -> DataFrame:
    """Rows per segment."""
    require_columns(df, segment)
    return df.groupBy(segment).agg(_count_rows().alias("n"))


def segment_exclusivity(df: DataFrame, id: Names, segment: str) -> DataFrame:
    """Entities by how many segments they have; a waterfall must give exactly one.

    ``status`` is ``none``, ``one`` or ``several``; an unknown segment is no segment.
    """
    require_columns(df, id, segment)
    per_entity = df.groupBy(*names(id)).agg(F.count_distinct(segment).alias("segments"))
    status = (
        F.when(F.col("segments") == 0, "none").when(F.col("segments") == 1, "one").otherwise("several")
    )
    return per_entity.groupBy(status.alias("status")).agg(_count_rows().alias("entities"))
