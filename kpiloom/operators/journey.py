"""What an entity did over time: cohorts, funnels, gaps, milestones, episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (
    DateLike,
    Names,
    between_days,
    day_of,
    month_of,
    months_apart,
    names,
    or_zero,
    pct,
    require_columns,
    shift_months,
    to_day,
    today_or,
)
from kpiloom.functions.hotkeys import DaySplit, split_by_day
from kpiloom.functions.ordered import split_in_order
from kpiloom.functions.tiers import first_match

# fixed values: names and limits in days of the gap classes
INDEX_FILL, CONTINUOUS, SHORT_GAP, LAPSE = "Index Fill", "Continuous", "Short Gap", "Lapse / Restart"
SHORT_DAYS, LAPSE_DAYS = 45, 90

# fixed values: outreach labels
CONTACTED, NOT_CONTACTED = "Contacted", "Not Contacted"


def cohort(df: DataFrame, id: str, date: str, offset: str = "calendar") -> DataFrame:
    """Distinct entities active per cohort month and months since the entity's first event.

    The events are first reduced to one row per entity and month (``calendar``) or day
    (``whole``, ``exact``). On that base the first event is a window minimum no longer than
    the calendar, so there is no join back to the events and no distinct count over them.
    """
    require_columns(df, id, date)
    dated = df.filter(F.col(date).isNotNull() & F.col(id).isNotNull())
    grain = month_of(date) if offset == "calendar" else day_of(date)
    active = dated.select(F.col(id).alias("id"), grain.alias("day")).distinct()
    first = F.min("day").over(Window.partitionBy("id"))
    placed = active.withColumn("first_day", first).select(
        "id",
        month_of("first_day").alias("cohort_month"),
        months_apart(F.col("day"), F.col("first_day"), offset).alias("months_since_start"),
    )
    by = ["cohort_month", "months_since_start"]
    if offset != "calendar":
        placed = placed.distinct()
    return placed.groupBy(*by).agg(F.count(F.lit(1)).alias("active_entities"))


# -- funnels -----------------------------------------------------------------------------


def funnel_flags(
    universe: DataFrame, steps: Sequence[tuple[str, DataFrame]], id: str
) -> DataFrame:
    """One row per entity of the universe with a 0/1 flag per step.

    Every step contributes distinct ids, so no join can multiply rows.
    """
    require_columns(universe, id)
    flags = universe.select(id).distinct()
    for name, step in steps:
        require_columns(step, id)
        reached = step.select(id).distinct().withColumn(name, F.lit(1))
        flags = flags.join(reached, id, "left")
    return flags.select(id, *[or_zero(name).alias(name) for name, _ in steps])


def funnel(universe: DataFrame, steps: Sequence[tuple[str, DataFrame]], id: str) -> DataFrame:
    """Entities per step and the share of each step in the one before, as one row."""
    flags = funnel_flags(universe, steps, id)
    counts = flags.agg(
        F.count(F.lit(1)).alias("universe"),
        *[or_zero(F.sum(name)).alias(name) for name, _ in steps],
    )
    order = ["universe", *[name for name, _ in steps]]
    rates = [
        pct(F.col(b), F.col(a)).alias(f"{a}_to_{b}_pct") for a, b in zip(order, order[1:])
    ]
    return counts.select("*", *rates)


def call_funnel(
    roster: DataFrame,
    calls: DataFrame,
    claims: DataFrame,
    activity_type: str,
    since: DateLike,
    ordered: bool = False,
) -> DataFrame:
    """Identified, called and claiming entities and the two conversion rates, as one row.

    A claim counts for called entities. With ``ordered`` its date must not be before the
    first call: the latest claim date decides that, so each table is reduced to one row per
    entity before they meet.
    """
    require_columns(roster, "entity_id")
    require_columns(calls, "entity_id", "activity_type", "activity_date")
    require_columns(claims, "entity_id", "service_date")
    from_day = F.lit(to_day(since))
    identified = roster.select("entity_id").distinct()
    called = (
        calls.filter(
            (F.col("activity_type") == activity_type) & (day_of("activity_date") >= from_day)
        )
        .groupBy("entity_id")
        .agg(F.min(day_of("activity_date")).alias("first_call"))
    )
    claimed = (
        claims.filter(day_of("service_date") >= from_day)
        .groupBy("entity_id")
        .agg(F.max(day_of("service_date")).alias("last_claim"))
    )
    follows = F.col("first_call").isNotNull() & F.col("last_claim").isNotNull()
    if ordered:
        follows = follows & (F.col("last_claim") >= F.col("first_call"))
    steps = (
        identified.join(called, "entity_id", "left")
        .join(claimed, "entity_id", "left")
        .agg(
            F.count("entity_id").alias("step_1_identified"),
            F.count("first_call").alias("step_2_called"),
            F.count_if(follows).alias("step_3_claimed"),
        )
    )
    return steps.select(
        "*",
        pct(F.col("step_2_called"), F.col("step_1_identified")).alias("call_rate_pct"),
        pct(F.col("step_3_claimed"), F.col("step_2_called")).alias("post_call_claim_rate_pct"),
    )


# -- summaries ---------------------------------------------------------------------------


def entity_summary(
    roster: DataFrame,
    claims: DataFrame,
    calls: DataFrame,
    customer: DataFrame,
    first: DateLike,
    last: DateLike,
    as_of: DateLike | None = None,
    months: int = 24,
) -> DataFrame:
    """Entities diagnosed in the ``months`` before ``as_of``, with claims and calls in a date range.

    One row per entity: the roster keeps each entity's latest diagnosis and both facts are
    summed per entity before the joins.
    """
    require_columns(roster, "entity_id", "diagnosis_date")
    require_columns(claims, "entity_id", "claim_id", "service_date", "paid_amount")
    require_columns(calls, "entity_id", "activity_date")
    require_columns(customer, "entity_id", "name", "region")
    end = today_or(as_of)
    recent = (
        roster.filter(between_days("diagnosis_date", shift_months(end, -months), end))
        .groupBy("entity_id")
        .agg(F.max(day_of("diagnosis_date")).alias("diagnosis_date"))
    )
    paid = (
        claims.filter(between_days("service_date", first, last))
        .groupBy("entity_id")
        .agg(
            F.sum("paid_amount").alias("total_paid"),
            F.count_distinct("claim_id").alias("claim_count"),
        )
    )
    contacts = (
        calls.filter(between_days("activity_date", first, last))
        .groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("total_calls"),
            F.max(day_of("activity_date")).alias("last_call_date"),
        )
    )
    joined = (
        recent.join(customer.select("entity_id", "name", "region"), "entity_id")
        .join(paid, "entity_id", "left")
        .join(contacts, "entity_id", "left")
    )
    return joined.select(
        "entity_id",
        "name",
        "region",
        "diagnosis_date",
        or_zero("total_paid").alias("total_paid"),
        or_zero("claim_count").alias("claim_count"),
        or_zero("total_calls").alias("total_calls"),
        "last_call_date",
        F.when(F.col("total_calls").isNotNull(), CONTACTED)
        .otherwise(NOT_CONTACTED)
        .alias("outreach_status"),
    )


# -- gaps --------------------------------------------------------------------------------


def classify_gaps(
    gaps: DataFrame, short: int = SHORT_DAYS, lapse: int = LAPSE_DAYS
) -> DataFrame:
    """Persistence status of each fill from its number and the days since the one before."""
    days = F.col("days_since_prior_fill")
    status = first_match(
        [
            (INDEX_FILL, F.col("fill_number") == 1),
            (CONTINUOUS, days <= short),
            (SHORT_GAP, days <= lapse),
        ],
        LAPSE,
    )
    return gaps.withColumn("persistence_status", status)


# how the rows of one key are split: by calendar day, or by quantiles of the whole order
BY_DAY, BY_ORDER = "day", "order"


def _split(rows: DataFrame, keys: Names, date: str, ties: Names, split: str) -> DaySplit:
    if split == BY_DAY:
        return split_by_day(rows, keys, date)
    if split == BY_ORDER:
        return split_in_order(rows, keys, [date, *names(ties)])
    raise ValueError(f"split must be {BY_DAY!r} or {BY_ORDER!r}, not {split!r}")


def fill_gaps(
    df: DataFrame,
    id: Names,
    date: str,
    tiebreak: Names,
    short: int = SHORT_DAYS,
    lapse: int = LAPSE_DAYS,
    keep: Names = (),
    split: str = BY_DAY,
) -> DataFrame:
    """Every fill with the fill before, the days between, its number and its status.

    Fills of one day follow each other with a gap of 0. Rows are shuffled once, by key and day
    (:mod:`kpiloom.functions.hotkeys`). With ``split="order"`` one key's single day and its undated rows
    are split too, for one more pass over the date and the tiebreak (:mod:`kpiloom.functions.ordered`).
    """
    keys, ties = names(id), names(tiebreak)
    require_columns(df, keys, date, ties, keep)
    fills = df.select(
        *dict.fromkeys([*keys, *ties, *names(keep)]), F.col(date).alias("fill_date")
    )
    split = _split(fills, keys, "fill_date", ties, split)

    in_order = split.window("fill_date", *ties)
    numbered = split.rows.withColumns(
        {
            "__prior": F.lag("fill_date").over(in_order),
            "__number": F.row_number().over(in_order),
        }
    )
    daily = split.per_day(
        F.max(split.whole("fill_date"))["fill_date"].alias("__last"),
        F.count(F.lit(1)).alias("__rows"),
    )
    days = split.along_days()  # or along the pieces of the order
    carried = daily.select(
        *split.parts,
        F.lag("__last").over(days).alias("__last_before"),
        F.sum("__rows")
        .over(days.rowsBetween(Window.unboundedPreceding, -1))
        .alias("__rows_before"),
    )
    prior = F.coalesce(F.col("__prior"), F.col("__last_before"))
    gaps = split.attach(numbered, carried).select(
        *fills.columns,
        prior.alias("prior_fill_date"),
        F.datediff("fill_date", prior).alias("days_since_prior_fill"),
        (F.col("__number") + or_zero("__rows_before")).alias("fill_number"),
    )
    return classify_gaps(gaps, short, lapse)


def fill_gaps_by_day(
    df: DataFrame, id: Names, date: str, short: int = SHORT_DAYS, lapse: int = LAPSE_DAYS
) -> DataFrame:
    """As :func:`fill_gaps` with the fills of one day counted as one.

    The reduction to days happens before the window, which then is as long as the calendar.
    """
    keys = names(id)
    require_columns(df, keys, date)
    daily = df.groupBy(*keys, day_of(date).alias("fill_date")).agg(
        F.count(F.lit(1)).alias("fills_on_day")
    )
    in_order = Window.partitionBy(*keys).orderBy("fill_date")
    prior = F.lag("fill_date").over(in_order)
    gaps = daily.select(
        "*",
        prior.alias("prior_fill_date"),
        F.row_number().over(in_order).cast("long").alias("fill_number"),
    ).withColumn("days_since_prior_fill", F.datediff("fill_date", "prior_fill_date"))
    return classify_gaps(gaps, short, lapse)


# -- cumulative stages -------------------------------------------------------------------


def provider_monthly(
    fills: DataFrame, product: str, floor: DateLike | None = None
) -> DataFrame:
    """Distinct patients with a new start of the product per provider and month.

    Unknown patients count for nothing: a provider-month with no known patient has no row.
    """
    require_columns(fills, "provider_id", "entity_id", "product", "service_date", "new_start")
    starts = fills.filter(
        (F.col("product") == product)
        & (F.col("new_start") == 1)
        & F.col("provider_id").isNotNull()
    )
    if floor is not None:
        starts = starts.filter(day_of("service_date") >= F.lit(to_day(floor)))
    return (
        starts.groupBy("provider_id", month_of("service_date").alias("month"))
        .agg(F.count_distinct("entity_id").alias("monthly_new_starts"))
        .filter("monthly_new_starts > 0")
    )


def provider_cumulative(monthly: DataFrame) -> DataFrame:
    """Running total per provider over its active months.

    A patient counts once in each month with a new start, so possibly several times in total.
    """
    require_columns(monthly, "provider_id", "month", "monthly_new_starts")
    running = (
        Window.partitionBy("provider_id")
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return monthly.withColumn(
        "cumulative_new_starts", F.sum("monthly_new_starts").over(running)
    )


def provider_stages(
    cumulative: DataFrame, exact: Sequence[tuple[str, int]], at_least: tuple[str, int]
) -> DataFrame:
    """Stage of a provider in each month: exact totals first, then the open-ended stage.

    Totals between the last exact stage and the open-ended one have no stage (NULL).
    """
    require_columns(cumulative, "cumulative_new_starts")
    total = F.col("cumulative_new_starts")
    tiers = [(label, total == n) for label, n in exact]
    tiers.append((at_least[0], total >= at_least[1]))
    return cumulative.filter(total > 0).withColumn("stage", first_match(tiers))


# fixed values: the two stage models (exact totals, open-ended stage)
THREE_STAGES = {"exact": (("Trialist", 1), ("User", 2)), "at_least": ("Adopter", 3)}
TWO_STAGES = {"exact": (("Trialist", 1),), "at_least": ("Adopter", 5)}


# -- episodes ----------------------------------------------------------------------------


def fill_episodes(
    fills: DataFrame,
    tiebreak: Names,
    floor: DateLike | None = None,
    where: Column | None = None,
    split: str = BY_DAY,
) -> DataFrame:
    """Every fill with the next fill, its episode and the episode's first date.

    A new start opens an episode, so the episode number is the running sum of new starts and
    the episode's first date is the date of the latest new start so far (the first fill of all
    before any). Rows are shuffled once, by patient, product and day
    (:mod:`kpiloom.functions.hotkeys`), or by pieces of the order as in :func:`fill_gaps`. Fills without
    a date are left out.
    """
    ties = names(tiebreak)
    keys = ["entity_id", "product"]
    carried_along = ["claim_id", "provider_id", "strength", "quantity", "days_supply"]
    require_columns(fills, keys, carried_along, "service_date", "new_start", "birth_year", ties)
    rows = fills.filter(F.col("service_date").isNotNull())
    if floor is not None:
        rows = rows.filter(day_of("service_date") >= F.lit(to_day(floor)))
    if where is not None:
        rows = rows.filter(where)
    rows = rows.select(
        *dict.fromkeys([*keys, *carried_along, *ties]),
        F.col("service_date").alias("fill_date"),
        (F.year("service_date") - F.nullif(F.col("birth_year"), F.lit(0))).alias("patient_age"),
        or_zero("new_start").alias("new_start"),
    )
    split = _split(rows, keys, "fill_date", ties, split)

    in_order = split.window("fill_date", *ties)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    start_date = F.when(F.col("new_start") > 0, F.col("fill_date"))
    sequenced = split.rows.withColumns(
        {
            "__next": F.lead("fill_date").over(in_order),
            "__starts": F.sum("new_start").over(so_far),
            "__last_start": F.max(start_date).over(so_far),
            "__first": F.min("fill_date").over(so_far),
        }
    )
    daily = split.per_day(
        F.min(split.whole("fill_date"))["fill_date"].alias("__day_first"),
        F.sum("new_start").alias("__day_starts"),
        F.max(start_date).alias("__day_last_start"),
    )
    days = split.along_days()
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select(
        *split.parts,
        F.lead("__day_first").over(days).alias("__next_day"),
        F.sum("__day_starts").over(before).alias("__starts_before"),
        F.max("__day_last_start").over(before).alias("__last_start_before"),
        F.min("__day_first").over(before).alias("__first_before"),
    )
    opened = F.coalesce(
        F.col("__last_start"),
        F.col("__last_start_before"),
        F.col("__first_before"),
        F.col("__first"),
    )
    return split.attach(sequenced, carried).select(
        *rows.columns,
        F.coalesce("__next", "__next_day").alias("next_fill_date"),
        (F.col("__starts") + or_zero("__starts_before")).alias("episode"),
        opened.alias("first_date"),
    )


# -- ordered funnels and distinct totals ---------------------------------------------------


def funnel_ordered(
    events: DataFrame, id: str, date: str, step: str, steps: Sequence[str], within_days: int
) -> DataFrame:
    """Entities that went through the steps in order, within ``within_days`` of the first one.

    One row per step: ``step_number``, ``step``, ``entities`` that reached it, ``pct_of_previous``,
    ``pct_of_first``. A step may follow on the same day. Every event of the first step can start a
    chain, so a late start counts where an early one would have run out of time.

    Events are reduced to one per entity, day and step (map-side); an entity's list is as long as the
    calendar times the steps at most. A state machine goes over it once: for each step it keeps the latest
    start of a chain that has come so far, which is the start that leaves most time.
    """
    require_columns(events, id, date, step)
    number = F.coalesce(*[F.when(F.col(step) == s, F.lit(i)) for i, s in enumerate(steps)])
    days = (
        events.select(F.col(id).alias("id"), F.datediff(day_of(date), F.lit("1970-01-01")).alias("day"), number.alias("at"))
        .dropna()
        .distinct()
    )
    lists = days.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("day", "at"))).alias("events"))

    none = F.array(*[F.lit(None).cast("int")] * len(steps))

    def went_on(starts: Column, event: Column) -> Column:
        def start(known: Column, place: Column) -> Column:
            before = F.when(event["at"] == 0, event["day"]).otherwise(F.get(starts, event["at"] - 1))
            in_time = F.when(event["day"] - before <= within_days, before)
            return F.when(place == event["at"], F.greatest(known, in_time)).otherwise(known)

        return F.transform(starts, start)

    ends = lists.select(F.aggregate("events", none, went_on).alias("starts"))
    reached = ends.agg(*[F.count(F.get("starts", F.lit(i))).alias(f"n{i}") for i in range(len(steps))])
    lines = [
        F.struct(
            F.lit(i + 1).alias("step_number"),
            F.lit(s).alias("step"),
            F.col(f"n{i}").alias("entities"),
            pct(F.col(f"n{i}"), F.col(f"n{max(i - 1, 0)}")).alias("pct_of_previous"),
            pct(F.col(f"n{i}"), F.col("n0")).alias("pct_of_first"),
        )
        for i, s in enumerate(steps)
    ]
    return reached.select(F.inline(F.array(*lines)))


def provider_cumulative_distinct(
    fills: DataFrame, product: str, floor: DateLike | None = None
) -> DataFrame:
    """Patients with a new start of the product per provider, each counted in the first month only.

    A row for each month in which the provider got patients it never had, with the running total. Every
    pair of provider and patient is reduced to its first month before anything is counted.
    """
    require_columns(fills, "provider_id", "entity_id", "product", "service_date", "new_start")
    starts = fills.filter(
        (F.col("product") == product)
        & (F.col("new_start") == 1)
        & F.col("provider_id").isNotNull()
        & F.col("entity_id").isNotNull()
    )
    if floor is not None:
        starts = starts.filter(day_of("service_date") >= F.lit(to_day(floor)))
    first = starts.groupBy("provider_id", "entity_id").agg(F.min(month_of("service_date")).alias("month"))
    monthly = first.filter("month IS NOT NULL").groupBy("provider_id", "month").agg(
        F.count(F.lit(1)).alias("new_patients")
    )
    running = (
        Window.partitionBy("provider_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    )
    return monthly.withColumn("cumulative_patients", F.sum("new_patients").over(running))
