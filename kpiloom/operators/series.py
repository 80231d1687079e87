"""Metrics over calendar months: spines, rolling windows, growth, goals, truncation.

The names of the result columns are fixed values: reports rely on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exprs import (
    DateLike,
    Names,
    between_days,
    day_of,
    in_months,
    month_of,
    month_start,
    names,
    or_zero,
    pct,
    ratio,
    require_columns,
    shift_months,
    today_or,
)

Period = tuple[DateLike, DateLike]


# -- spines ------------------------------------------------------------------------------


def _months(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 month")))


def month_spine(spark: SparkSession, first: DateLike, last: DateLike | None = None) -> DataFrame:
    """One row per month from ``first`` to ``last`` (today when not given)."""
    start, end = F.lit(month_start(first)), F.lit(month_start(today_or(last)))
    return spark.range(1).select(_months(start, end).alias("month"))


def fill_on_spine(metric: DataFrame, spine: DataFrame, value: Names) -> DataFrame:
    """The metric on every month of the spine, 0 where it has no row."""
    require_columns(metric, "month", value)
    filled = spine.select("month").join(metric.select("month", *names(value)), "month", "left")
    return filled.select("month", *[or_zero(v).alias(v) for v in names(value)])


def fill_months(
    metric: DataFrame,
    keys: Names,
    value: Names,
    first: DateLike | None = None,
    last: DateLike | None = None,
) -> DataFrame:
    """The metric on every month of each key, 0 where it has no row.

    From the key's first month to its last, or over the range given. Every row brings the
    missing months up to the key's next row with it, so the metric is read once and the keys
    are not collected separately. Rows without a month are left out.
    """
    require_columns(metric, "month", keys, value)
    by, values = names(keys), names(value)
    in_order = Window.partitionBy(*by).orderBy("month")
    following = F.lead("month").over(in_order)
    preceding = F.lag("month").over(in_order)
    start, end = F.col("month"), F.col("month")
    if first is not None:
        start = F.when(preceding.isNull(), F.least(F.lit(month_start(first)), start)).otherwise(start)
    if last is not None:
        end = F.greatest(F.lit(month_start(last)), end)
    end = F.coalesce(F.add_months(following, -1), end)
    spread = (
        metric.filter(F.col("month").isNotNull())
        .withColumns({"__start": start, "__end": end})
        .select(
            *by,
            *values,
            F.col("month").alias("__own"),
            _months(F.col("__start"), F.col("__end")).alias("month"),
        )
    )
    own = F.col("month") == F.col("__own")
    filled = spread.select(
        "month", *by, *[F.when(own, or_zero(v)).otherwise(0).alias(v) for v in values]
    )
    if first is not None:
        filled = filled.filter(F.col("month") >= F.lit(month_start(first)))
    if last is not None:
        filled = filled.filter(F.col("month") <= F.lit(month_start(last)))
    return filled


def monthly_entities(
    df: DataFrame, id: str, date: str, by: Names = (), out: str = "metric_value"
) -> DataFrame:
    """Distinct entities per month, and per group when ``by`` is given."""
    require_columns(df, id, date, by)
    return df.groupBy(month_of(date).alias("month"), *names(by)).agg(
        F.count_distinct(id).alias(out)
    )


# -- rolling -----------------------------------------------------------------------------


def _last_rows(keys: Names, rows: int) -> Window:
    return Window.partitionBy(*names(keys)).orderBy("month").rowsBetween(1 - rows, 0)


def rolling(
    df: DataFrame, id: Names, date: str, value: str, months: int = 3, gap_fill: bool = False
) -> DataFrame:
    """Monthly sum per key with its rolling sum and average.

    Rows are summed to months first, so a window holds as many rows as a key has months. The
    window counts months with data; ``gap_fill`` adds the missing months between a key's
    first and last as zeros, which makes it count calendar months.
    """
    require_columns(df, id, date, value)
    keys = names(id)
    monthly = df.groupBy(month_of(date).alias("month"), *keys).agg(
        F.sum(value).alias("monthly_value")
    )
    if gap_fill:
        monthly = fill_months(monthly, keys, "monthly_value")
    window = _last_rows(keys, months)
    total = F.sum("monthly_value").over(window)
    return monthly.select(
        "month",
        *keys,
        "monthly_value",
        total.alias(f"rolling_{months}m_sum"),
        ratio(total, F.count("monthly_value").over(window)).alias(f"rolling_{months}m_avg"),
    )


def rolling_range(
    df: DataFrame, date: str, value: str, months: int = 3, by: Names = ()
) -> DataFrame:
    """Per date, the sum over the calendar months that end on it.

    The dates a report shows decide which row is read: the last visible one is the measure's
    value. Values are summed to days first, so the window is over the calendar.
    """
    require_columns(df, date, value, by)
    keys = names(by)
    daily = df.groupBy(day_of(date).alias("as_of_date"), *keys).agg(
        F.sum(value).alias("daily_value")
    )
    partition = f"partition by {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    frame = f"range between interval {months} month preceding and current row"
    rolling_sum = F.expr(f"sum(daily_value) over ({partition}order by as_of_date {frame})")
    return daily.filter("as_of_date is not null").select(
        *keys, "as_of_date", "daily_value", rolling_sum.alias(f"rolling_{months}m")
    )


def rolling_new_starts(
    fills: DataFrame,
    product: str,
    first: DateLike,
    last: DateLike,
    months: int = 6,
    warmup: bool = False,
) -> DataFrame:
    """Rolling new starts per provider and product over the last ``months`` active months.

    Without ``warmup`` the first months of the range see only what lies inside it; with it the
    look-back reads the months before, which are then left out of the result.
    """
    require_columns(fills, "provider_id", "product", "service_date", "new_start")
    read_from = shift_months(month_start(first), 1 - months) if warmup else first
    monthly = (
        fills.filter((F.col("product") == product) & in_months("service_date", read_from, last))
        .groupBy("provider_id", "product", month_of("service_date").alias("month"))
        .agg(F.sum("new_start").alias("new_starts"))
    )
    total = F.sum("new_starts").over(_last_rows(["provider_id", "product"], months))
    rolled = monthly.withColumn(f"rolling_{months}m", total)
    return rolled.filter(F.col("month") >= F.lit(month_start(first))) if warmup else rolled


# -- trends and growth -------------------------------------------------------------------


def monthly_trend(
    claims: DataFrame,
    as_of: DateLike | None = None,
    months: int = 12,
    by: Names = (),
    gap_fill: bool = False,
    places: DataFrame | None = None,
) -> DataFrame:
    """Monthly total, distinct entities, prior month and its percentage change.

    Starts ``months`` months before the month of ``as_of`` and ends with ``as_of``, so the last
    month may be a part month. The prior month is the previous one with data; ``gap_fill`` makes it the previous calendar
    month.
    ``places``, with one row per entity, has the ``by`` columns if the claims don't; it meets the
    entities' monthly sums, so a large entity never meets it row by row.
    """
    require_columns(claims, "entity_id", "service_date", "paid_amount")
    require_columns(claims if places is None else places, "entity_id", by)
    as_of = today_or(as_of)
    keys = names(by)
    first = shift_months(month_start(as_of), -months)
    rows = claims.filter(between_days("service_date", first, as_of)).withColumn(
        "month", month_of("service_date")
    )
    if places is not None:
        summed = rows.groupBy("entity_id", "month").agg(F.sum("paid_amount").alias("paid_amount"))
        rows = summed.join(places.select("entity_id", *keys), "entity_id", "left")
    monthly = rows.groupBy("month", *keys).agg(
        F.sum("paid_amount").alias("total_paid"),
        F.count_distinct("entity_id").alias("unique_entities"),
    )
    measures = ["total_paid", "unique_entities"]
    if gap_fill and keys:
        monthly = fill_months(monthly, keys, measures, first, as_of)
    elif gap_fill:
        spine = month_spine(claims.sparkSession, first, as_of)
        monthly = fill_on_spine(monthly, spine, measures)
    # without groups this is a window over the months of the trend only
    in_order = Window.partitionBy(*keys).orderBy("month")
    prior = F.lag("total_paid").over(in_order)
    return monthly.withColumn("prior_month_paid", prior).withColumn(
        "mom_pct_change",
        pct(F.col("total_paid") - F.col("prior_month_paid"), F.col("prior_month_paid")),
    )


def yoy(
    df: DataFrame,
    id: Names,
    date: str,
    as_of: DateLike | None = None,
    ytd_aligned: bool = False,
) -> DataFrame:
    """Rows of the current and the prior calendar year per key, and their change.

    Keys seen only two years back are kept with zero counts. Rows after ``as_of`` don't count,
    so the current year is a part year; ``ytd_aligned`` compares it with the same part of the
    prior year.
    """
    require_columns(df, id, date)
    as_of = today_or(as_of)
    day = day_of(date)
    this_year = F.year(day) == as_of.year
    last_year = F.year(day) == as_of.year - 1
    if ytd_aligned:
        last_year = last_year & (day <= F.lit(shift_months(as_of, -12)))
    counts = (
        df.filter(between_days(date, as_of.replace(year=as_of.year - 2, month=1, day=1), as_of))
        .groupBy(*names(id))
        .agg(F.count_if(this_year).alias("cy_count"), F.count_if(last_year).alias("py_count"))
    )
    change = F.col("cy_count") - F.col("py_count")
    return counts.select(
        "*",
        change.alias("yoy_abs_change"),
        pct(change, F.col("py_count")).alias("yoy_pct_change"),
    )


def _period_sums(value: str, date: str, pre: Period, post: Period) -> list[Column]:
    return [
        F.sum(F.when(in_months(date, *pre), F.col(value)).otherwise(0)).alias("pre"),
        F.sum(F.when(in_months(date, *post), F.col(value)).otherwise(0)).alias("post"),
    ]


def _growth(sums: DataFrame) -> DataFrame:
    change = F.col("post") - F.col("pre")
    return sums.select(
        "*", change.alias("abs_change"), pct(change, F.col("pre")).alias("pct_change")
    )


def period_growth(
    df: DataFrame,
    date: str,
    value: str,
    pre: Period,
    post: Period,
    by: Names = (),
    where: Column | None = None,
) -> DataFrame:
    """Totals of two ranges of whole months and their change, per key or as one row.

    One pass with conditional sums. It keeps keys that have rows in one range only, as a full
    outer join of the two ranges would. Rows with an unknown key match nothing and are left
    out; :func:`kpiloom.operators.quality.fanout_check` counts them.
    """
    require_columns(df, date, value, by)
    keys = names(by)
    rows = df.filter(in_months(date, *pre) | in_months(date, *post))
    if where is not None:
        rows = rows.filter(where)
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    sums = rows.groupBy(*keys).agg(*_period_sums(value, date, pre, post))
    # a key whose values are all unknown counts as zero; the one-row total stays unknown
    return _growth(sums.fillna(0, ["pre", "post"]) if keys else sums)


# -- audits and goals --------------------------------------------------------------------


def truncation_audit(
    df: DataFrame, date: str, threshold: float = 0.8, last: int = 6
) -> DataFrame:
    """Rows per month against the peak and the prior month, for the latest months.

    The latest month is marked truncated when it has less than ``threshold`` of the rows of
    the month before.
    """
    require_columns(df, date)
    monthly = df.groupBy(month_of(date).alias("month")).agg(F.count(F.lit(1)).alias("row_count"))
    return truncation_of_counts(monthly, threshold, last)


def truncation_of_counts(monthly: DataFrame, threshold: float = 0.8, last: int = 6) -> DataFrame:
    """:func:`truncation_audit` of counts by month, as ``month`` and ``row_count``."""
    require_columns(monthly, "month", "row_count")
    # windows over one row per calendar month
    everything = Window.partitionBy()
    in_order = Window.orderBy("month")
    shares = monthly.select(
        "month",
        "row_count",
        ratio(F.col("row_count"), F.max("row_count").over(everything)).alias("pct_of_peak_month"),
        ratio(F.col("row_count"), F.lag("row_count").over(in_order)).alias("pct_of_prior_month"),
        (F.col("month") == F.max("month").over(everything)).alias("__latest"),
    )
    truncated = F.col("__latest") & (F.col("pct_of_prior_month") < threshold)
    return (
        shares.withColumn("is_truncated", F.when(truncated, 1).otherwise(0))
        .drop("__latest")
        .orderBy(F.col("month").desc())
        .limit(last)
    )


def freshness(df: DataFrame, date: str, as_of: DateLike | None = None) -> DataFrame:
    """Latest date in the table and its distance from the reference date."""
    require_columns(df, date)
    latest = F.max(day_of(date))
    return df.agg(latest.alias("latest_record_date")).select(
        "*", F.datediff(F.lit(today_or(as_of)), F.col("latest_record_date")).alias("lag_days")
    )


def monthly_actuals(df: DataFrame, date: str, keys: Names, value: Column) -> DataFrame:
    """One row per month and key: the actual side of :func:`actuals_vs_goals`."""
    require_columns(df, date, keys)
    return df.groupBy(month_of(date).alias("month"), *names(keys)).agg(value.alias("actual_value"))


def actuals_vs_goals(actuals: DataFrame, goals: DataFrame, keys: Names) -> DataFrame:
    """Actuals and goals side by side, with the months and keys of either.

    Keys are compared as text, whatever types the two tables use; values keep theirs.
    Unknown keys match nothing and would come out as two loose rows; they are left out.
    """
    on = ["month", *names(keys)]
    require_columns(actuals, on, "actual_value")
    require_columns(goals, on, "goal_value")

    def aligned(df: DataFrame, value: str) -> DataFrame:
        whole = isinstance(df.schema[value].dataType, T.IntegralType)
        typed = df.select(
            month_of("month").alias("month"),
            *[F.col(k).cast("string").alias(k) for k in names(keys)],
            (F.col(value).cast("long") if whole else F.col(value)).alias(value),
        )
        return typed.dropna(subset=on)

    merged = aligned(actuals, "actual_value").join(
        aligned(goals, "goal_value"), on, "full_outer"
    )
    filled = merged.select(
        "*",
        or_zero("actual_value").alias("actual_filled"),
        or_zero("goal_value").alias("goal_filled"),
    )
    return filled.withColumn("pct_to_goal", pct(F.col("actual_filled"), F.col("goal_filled")))
