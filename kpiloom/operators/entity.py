"""One row per entity: latest record, milestones, rankings, entity lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (
    DateLike,
    Names,
    between_days,
    day_of,
    flag,
    names,
    require_columns,
)
from kpiloom.functions.tiers import at_least, first_match
from kpiloom.sources.stage import reliable_copy, stage_table

# fixed values: stage names and distinct-day thresholds of the ever-flag classification
EVER_STAGES = (("Adopter", 4), ("User", 2), ("Trialist", 1))
NO_STAGE = "None"


def _descending(columns: Names) -> list[Column]:
    return [F.col(c).desc() for c in names(columns)]


def latest_per_key(df: DataFrame, keys: Names, date: str, tiebreak: Names) -> DataFrame:
    """The latest row per key; ties on the date go to the highest ``tiebreak``.

    Catalyst turns ``row_number() = 1`` into a group limit on both sides of the shuffle, so a
    key sends at most one row per map task however many rows it has.
    """
    require_columns(df, keys, date, tiebreak)
    latest_first = Window.partitionBy(*names(keys)).orderBy(*_descending([date, *names(tiebreak)]))
    return (
        df.withColumn("__rn", F.row_number().over(latest_first)).filter("__rn = 1").drop("__rn")
    )


def ever_flag(
    df: DataFrame,
    keys: Names,
    date: str,
    stages: Sequence[tuple[str, int]] = EVER_STAGES,
    no_stage: str = NO_STAGE,
) -> DataFrame:
    """First date, distinct days and rows per key, the highest stage reached, a flag per stage.

    Once a key has the days for a stage it keeps it: the flags are cumulative, the
    classification is the highest of them.
    """
    require_columns(df, keys, date)
    counts = df.groupBy(*names(keys)).agg(
        F.min(day_of(date)).alias("first_event_date"),
        F.count_distinct(day_of(date)).alias("distinct_event_days"),
        F.count(F.lit(1)).alias("total_events"),
    )
    label = first_match(at_least("distinct_event_days", stages), no_stage)
    flags = [
        flag(F.col("distinct_event_days") >= n).alias(f"is_{name.lower()}") for name, n in stages
    ]
    return counts.select("*", label.alias("classification"), *flags)


def top_n(
    df: DataFrame, id: str, value: str, segment: str, n: int, tiebreak: Names | None = None
) -> DataFrame:
    """The ``n`` highest values with their overall, dense and within-segment ranks.

    Only the ``n`` winners are ranked. That is exact: all three ranks use one total order, so
    whatever ranks above a winner, overall or within its segment, is itself a winner.
    """
    order_names = [value, *names(tiebreak or id)]
    require_columns(df, id, value, segment, order_names)
    order = _descending(order_names)
    winners = df.orderBy(*order).limit(n)
    overall = Window.orderBy(*order)
    by_value = Window.orderBy(F.col(value).desc())
    return winners.select(
        *dict.fromkeys([id, value, segment, *order_names]),
        F.row_number().over(overall).alias("overall_rank"),
        F.dense_rank().over(by_value).alias("overall_rank_dense"),
        F.row_number().over(Window.partitionBy(segment).orderBy(*order)).alias("rank_within_segment"),
    )


def rank_all(
    df: DataFrame,
    id: str,
    value: str,
    segment: str,
    tiebreak: Names | None = None,
    path: str | None = None,
) -> DataFrame:
    """The three ranks of :func:`top_n` for every row, without a single-task window.

    The rows are range-partitioned once and stored, which fixes the content of every
    partition. Ranks are then local ranks plus the totals of the partitions before.

    The copy is written at ``path``, on storage that all executors share, and must stay until the
    result has been used; :func:`kpiloom.sources.stage.remove` then takes it away. Without a path
    it lies below the checkpoint folder, which the cluster's own retention clears.
    """
    order_names = [value, *names(tiebreak or id)]
    columns = list(dict.fromkeys([id, value, segment, *order_names]))
    require_columns(df, columns)
    order = _descending(order_names)
    by_range = df.select(*columns).repartitionByRange(*order).withColumn(
        "__part", F.spark_partition_id()
    )
    ranged = stage_table(by_range, path) if path else reliable_copy(by_range)

    in_part = Window.partitionBy("__part").orderBy(*order)
    in_part_by_value = Window.partitionBy("__part").orderBy(F.col(value).desc())
    in_segment = Window.partitionBy("__part", segment).orderBy(*order)
    local = ranged.select(
        "*",
        F.row_number().over(in_part).alias("__row"),
        F.dense_rank().over(in_part_by_value).alias("__dense"),
        F.row_number().over(in_segment).alias("__segment_row"),
    )

    # one row per partition of the sort, so the unpartitioned window is over a few thousand rows
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count_distinct(F.col(value)).alias("__values"),
        F.max(F.col(value).isNull().cast("int")).alias("__null_value"),
        F.max(value).alias("__high"),
        F.min(value).alias("__low"),
    )
    # a value that straddles two partitions counts once; NULLs sort last and are one value
    previous_low = F.lag("__low").over(Window.orderBy("__part"))
    previous_null = F.coalesce(F.lag("__null_value").over(Window.orderBy("__part")), F.lit(0))
    shared = (
        F.when(previous_null == 1, 1)
        .when(previous_low == F.col("__high"), 1)
        .otherwise(0)
    )
    joined_on = totals.withColumn("__shared", shared)
    through = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = joined_on.select(
        "__part",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        (
            F.coalesce(F.sum(F.col("__values") + F.col("__null_value")).over(before), F.lit(0))
            - F.sum("__shared").over(through)
        ).alias("__dense_before"),
    )
    before_in_segment = (
        Window.partitionBy(segment).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    segment_offsets = ranged.groupBy("__part", segment).agg(
        F.count(F.lit(1)).alias("__rows")
    ).select(
        "__part",
        F.col(segment).alias("__segment"),
        F.coalesce(F.sum("__rows").over(before_in_segment), F.lit(0)).alias("__segment_before"),
    )

    # one row per partition of the sort: never more than the partitioner's partition count
    placed = local.join(F.broadcast(offsets), "__part").alias("l")
    same_segment = (F.col("l.__part") == F.col("s.__part")) & F.col(f"l.{segment}").eqNullSafe(
        F.col("s.__segment")
    )
    return placed.join(segment_offsets.alias("s"), same_segment).select(
        *[F.col(f"l.{c}") for c in columns],
        (F.col("__rows_before") + F.col("__row")).alias("overall_rank"),
        (F.col("__dense_before") + F.col("__dense")).alias("overall_rank_dense"),
        (F.col("__segment_before") + F.col("__segment_row")).alias("rank_within_segment"),
    )


def top_cost(
    claims: DataFrame,
    roster: DataFrame,
    customer: DataFrame,
    first: DateLike,
    last: DateLike,
    n: int = 10,
    per_roster_row: bool = False,
) -> DataFrame:
    """Roster members with the highest paid amount in a date range, with dimension columns.

    Claims are reduced to one row per entity before they meet the roster, and the dimension is
    joined to the ``n`` winners only. ``per_roster_row`` repeats an entity's amount for each of
    its roster rows, which is what an inner join to a roster with repeated entities gives.
    """
    require_columns(claims, "entity_id", "claim_id", "service_date", "paid_amount")
    require_columns(roster, "entity_id")
    require_columns(customer, "entity_id", "name", "region")
    paid = (
        claims.filter(between_days("service_date", first, last))
        .groupBy("entity_id")
        .agg(
            F.sum("paid_amount").alias("total_paid"),
            F.count_distinct("claim_id").alias("claim_count"),
        )
    )
    if per_roster_row:
        rows = roster.groupBy("entity_id").agg(F.count(F.lit(1)).alias("__rows"))
        members = paid.join(rows, "entity_id").select(
            "entity_id", (F.col("total_paid") * F.col("__rows")).alias("total_paid"), "claim_count"
        )
    else:
        members = paid.join(roster.select("entity_id").distinct(), "entity_id", "left_semi")
    order = [F.col("total_paid").desc(), F.col("entity_id")]
    winners = members.orderBy(*order).limit(n).withColumn(
        "cost_rank", F.row_number().over(Window.orderBy(*order))
    )
    dimension = customer.select("entity_id", "name", "region")
    return winners.join(dimension, "entity_id", "left").select(
        "cost_rank", "entity_id", "name", "region", "total_paid", "claim_count"
    )


def net_new_list(monthly: DataFrame) -> DataFrame:
    """First active month of each provider. Input: one row per provider and active month."""
    require_columns(monthly, "provider_id", "month")
    return (
        monthly.groupBy("provider_id")
        .agg(F.min("month").alias("month"))
        .withColumn("is_net_new", F.lit(1))
    )


def net_new_summary(monthly: DataFrame) -> DataFrame:
    """Providers whose first active month it is, per month, and their running total."""
    per_month = net_new_list(monthly).groupBy("month").agg(
        F.count(F.lit(1)).alias("net_new_providers")
    )
    # one row per calendar month
    running = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return per_month.withColumn(
        "cumulative_net_new", F.sum("net_new_providers").over(running)
    )


def detailed_providers(
    calls: DataFrame,
    product: str,
    department: str,
    excluded_classes: Sequence[str],
    purpose: str,
    contact_type: str,
    first: DateLike,
    last: DateLike,
) -> DataFrame:
    """Distinct providers with a qualifying call.

    A call with an unknown classification does not qualify: it cannot be told apart from the
    excluded ones.
    """
    require_columns(
        calls,
        "provider_id",
        "product",
        "department",
        "classification",
        "purpose",
        "contact_type",
        "activity_date",
    )
    qualifying = (
        (F.col("product") == product)
        & (F.col("department") == department)
        & ~F.col("classification").isin(*excluded_classes)
        & (F.col("purpose") == purpose)
        & (F.col("contact_type") == contact_type)
        & between_days("activity_date", first, last)
    )
    return calls.filter(qualifying).select("provider_id").distinct()


def age_group_writers(
    fills: DataFrame, below_age: int, first: DateLike, last: DateLike
) -> DataFrame:
    """Distinct providers with a new start for a patient below an age.

    The age is the difference of years. Birth year 0 means unknown and never qualifies.
    """
    require_columns(fills, "provider_id", "new_start", "service_date", "birth_year")
    age = F.year("service_date") - F.nullif(F.col("birth_year"), F.lit(0))
    return (
        fills.filter(F.col("new_start") == 1)
        .filter(between_days("service_date", first, last))
        .filter(age < below_age)
        .select("provider_id")
        .distinct()
    )
