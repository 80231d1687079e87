"""Segmentation by priority: tiers, comorbidity, accounts, therapy lines, dosing, routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (
    DateLike,
    Names,
    all_of,
    any_of,
    contains_any,
    day_of,
    flag,
    month_start,
    names,
    ratio,
    require_columns,
    today_or,
)
from kpiloom.functions.tiers import (
    AccountRule,
    DosingRule,
    RouteRule,
    Tier,
    first_match,
    first_match_column,
)


def waterfall(
    df: DataFrame,
    tiers: Sequence[Tier],
    default: str | None = "Other",
    out: str = "segment",
    flags: bool = True,
) -> DataFrame:
    """The first tier that matches, and a 0/1 flag for every tier on its own.

    The segment is exclusive, the flags are not: a row may match several tiers.
    """
    tier_flags = [flag(cond).alias(f"flag_tier_{i}") for i, (_, cond) in enumerate(tiers, 1)]
    label = first_match(tiers, default).alias(out)
    return df.select("*", label, *(tier_flags if flags else []))


# -- comorbidity -------------------------------------------------------------------------

# fixed values: the segment names when the conditions are called a and b
BOTH, NEITHER = "Comorbid", "Neither"


def comorbidity(
    customer: DataFrame, roster_a: DataFrame, roster_b: DataFrame, a: str = "A", b: str = "B"
) -> DataFrame:
    """Active customers by membership in two rosters: both, one only, or neither."""
    require_columns(customer, "entity_id", "name", "region", "status")
    require_columns(roster_a, "entity_id")
    require_columns(roster_b, "entity_id")

    def members(roster: DataFrame, column: str) -> DataFrame:
        return roster.select("entity_id").distinct().withColumn(column, F.lit(1))

    tagged = (
        customer.filter(F.col("status") == "active")
        .select("entity_id", "name", "region")
        .join(members(roster_a, "__a"), "entity_id", "left")
        .join(members(roster_b, "__b"), "entity_id", "left")
    )
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    segment = first_match(
        [(BOTH, in_a & in_b), (f"{a} Only", in_a), (f"{b} Only", in_b)], NEITHER
    )
    return tagged.select(
        "entity_id",
        "name",
        "region",
        flag(in_a).alias("has_a"),
        flag(in_b).alias("has_b"),
        segment.alias("condition_segment"),
    )


# -- accounts ----------------------------------------------------------------------------

# fixed values: account segments and the trainee thresholds of the academic tier
ACADEMIC, NETWORK, OTHER_ACCOUNT = "Academic", "IDN", "Other"
COMMUNITY, NON_COMMUNITY = "Community", "Non-Community"
MIN_KNOWN, MIN_TRAINEE_SHARE = 30, 0.15


def training_cutoff(as_of: DateLike | None = None):
    """30 September of the training year: this year's until September, next year's after."""
    day = today_or(as_of)
    return day.replace(year=day.year + (day.month > 9), month=9, day=30)


def trainee_ratio(
    provider_account: DataFrame, training: DataFrame, as_of: DateLike | None = None
) -> DataFrame:
    """Trainees, others, providers with a known date, all providers and the share, per account.

    A provider is a trainee while the training ends after the cutoff. The share is a decimal
    percentage of four places, divided by 100.
    """
    require_columns(provider_account, "provider_id", "account_id")
    require_columns(training, "provider_id", "training_to")
    cutoff = F.lit(training_cutoff(as_of))
    ends = day_of("training_to")
    counts = (
        provider_account.select("provider_id", "account_id")
        .join(training.select("provider_id", "training_to"), "provider_id", "left")
        .groupBy("account_id")
        .agg(
            F.count_if(ends > cutoff).alias("trainees"),
            F.count_if(ends <= cutoff).alias("non_trainees"),
            F.count("provider_id").alias("providers"),
        )
        .withColumn("known", F.col("trainees") + F.col("non_trainees"))
    )
    share = F.col("trainees").cast("decimal(18,4)") * 100 / F.nullif(
        F.col("known").cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")
    )
    return counts.withColumn("trainee_share", F.round(share, 4).cast("decimal(10,4)") / 100)


def forced_overrides(account_flags: DataFrame) -> DataFrame:
    """Accounts with a fixed segment; the first label in order where an account has several."""
    require_columns(account_flags, "account_id", "label", "flag_a", "flag_b")
    return (
        account_flags.filter((F.col("flag_a") == 1) | (F.col("flag_b") == 1))
        .groupBy("account_id")
        .agg(F.min("label").alias("forced_segment"))
    )


def _same_name(column: str) -> Column:
    return F.upper(F.trim(column))


def network_names(organisations: DataFrame, facility: str) -> DataFrame:
    """Distinct normalised names of organisations with the facility type."""
    require_columns(organisations, "business_name", "facility_type")
    return (
        organisations.filter(
            contains_any("facility_type", [facility]) & F.col("business_name").isNotNull()
        )
        .select(_same_name("business_name").alias("network_name"))
        .distinct()
    )


def account_segment(
    hierarchy: DataFrame,
    provider_account: DataFrame,
    account_flags: DataFrame,
    organisations: DataFrame,
    training: DataFrame,
    account_rules: Sequence[AccountRule],
    academic_words: Sequence[str],
    facility: str,
    as_of: DateLike | None = None,
    min_known: int = MIN_KNOWN,
    min_share: float = MIN_TRAINEE_SHARE,
) -> DataFrame:
    """Account segment of every provider in five layers, the first that matches.

    Forced override; account rules; academic (trainee share or a word in the name); network
    name; other. What is known per account is merged into one row per account first, so the
    providers, of which one account may hold many, meet it in a single join.
    """
    require_columns(hierarchy, "provider_id", "level2_id", "level3_id")
    require_columns(
        provider_account, "provider_id", "account_id", "account_name", "customer_ref"
    )
    base = hierarchy.select("provider_id", "level2_id", "level3_id").join(
        provider_account.select("provider_id", "account_id", "account_name", "customer_ref"),
        "provider_id",
        "left",
    )
    per_account = forced_overrides(account_flags).join(
        trainee_ratio(provider_account, training, as_of), "account_id", "full_outer"
    )
    networks = network_names(organisations, facility)
    joined = base.join(per_account, "account_id", "left").join(
        networks, _same_name("account_name") == F.col("network_name"), "left"
    )
    by_share = (F.col("known") >= min_known) & (F.col("trainee_share") >= min_share)
    tiers = [
        (F.col("forced_segment"), F.col("forced_segment").isNotNull()),
        *[(F.lit(rule.label), rule.condition()) for rule in account_rules],
        (F.lit(ACADEMIC), by_share | contains_any("account_name", academic_words)),
        (F.lit(NETWORK), F.col("network_name").isNotNull()),
    ]
    return joined.select(
        "provider_id",
        "customer_ref",
        "account_id",
        "account_name",
        first_match_column(tiers, F.lit(OTHER_ACCOUNT)).alias("account_segment_granular"),
    )


def account_rollup(segments: DataFrame, kept: str = COMMUNITY, rest: str = NON_COMMUNITY) -> DataFrame:
    """The granular segment rolled up to two values."""
    require_columns(segments, "account_segment_granular")
    is_kept = F.col("account_segment_granular") == kept
    return segments.withColumn("account_segment", F.when(is_kept, kept).otherwise(rest))


# -- therapy lines -----------------------------------------------------------------------


def regimen_class(
    focal: str, partner: str, base: Sequence[str], labels: dict[str, str]
) -> Column:
    """Class of a regimen text: focal, base plus partner, partner, base, other."""
    regimen = F.col("regimen")
    has_partner = regimen.contains(partner)
    has_base = any_of(regimen.contains(word) for word in base)
    return first_match(
        [
            (labels["focal"], regimen.contains(focal)),
            (labels["combined"], has_partner & has_base),
            (labels["partner"], has_partner),
            (labels["base"], has_base),
        ],
        labels["other"],
    )


def eligibility_bucket(labels: Sequence[str]) -> Column:
    """Eligibility bucket of a line from the earliest lines of three classes.

    In order: after both first lines and not after the first focal line; after the first line
    of class a and not after the first focal line; first line; before any class a line. A
    comparison with an unknown line does not match, so some lines have no bucket.
    """
    line, a, b = F.col("line"), F.col("first_line_a"), F.col("first_line_b")
    focal = F.col("first_line_focal")
    not_after_focal = focal.isNull() | (line <= focal)
    after_both, after_one, first_line, naive = labels
    return first_match(
        [
            (after_both, (line > a) & (line > b) & not_after_focal),
            (after_one, (line > a) & not_after_focal),
            (first_line, line == 1),
            (naive, a.isNull() | ((line < a) & (line >= 2))),
        ]
    )


LINE_KEY = ["patient_id", "month", "line"]


def bucket_classified(
    lines: DataFrame,
    regimen: Column,
    bucket: Column,
    eligible_from: DateLike,
    floor: DateLike,
) -> DataFrame:
    """Line starts per provider, patient, line, month, eligibility, regimen class and bucket.

    ``floor`` is compared on the month, as text ``yyyy-MM``, so on the raw date it is the
    first of that month. Rows are placed by patient, month and line once: the distinct rows,
    the sums and the best priority of :func:`bucket_priority` need no further shuffle.
    """
    measures = ["line_initiation", "first_line_a", "first_line_b", "first_line_focal"]
    require_columns(lines, "patient_id", "provider_id", "regimen", "line", "start_date", measures)
    eligible = day_of("start_date") >= F.lit(month_start(eligible_from))
    started = (
        lines.filter(F.col("line_initiation") == 1)
        .filter(day_of("start_date") >= F.lit(month_start(floor)))
        .select(
            "patient_id",
            "provider_id",
            "regimen",
            "line",
            F.date_format("start_date", "yyyy-MM").alias("month"),
            flag(eligible).alias("eligible"),
            *measures,
        )
        .repartition(*LINE_KEY)
        .distinct()
    )
    tagged = started.select(
        *LINE_KEY,
        "provider_id",
        "eligible",
        regimen.alias("regimen_class"),
        bucket.alias("bucket"),
        "line_initiation",
    ).filter(F.col("bucket").isNotNull())
    return (
        tagged.groupBy(*LINE_KEY, "provider_id", "eligible", "regimen_class", "bucket")
        .agg(F.sum("line_initiation").alias("patients"))
        .filter("patients > 0")
    )


def bucket_priority(classified: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows in the best bucket of their patient, month and line; ties are kept.

    ``labels`` lists the buckets from best to worst; rows in none of them are left out, and so
    are rows of an unknown patient, month or line, which belong to no other row (see
    :func:`kpiloom.operators.quality.fanout_check` for their number). Rank 1 becomes a group
    limit, which lets the other rows go while it reads a group.
    """
    require_columns(classified, LINE_KEY, "bucket")
    place = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("bucket"))
    best_first = Window.partitionBy(*LINE_KEY).orderBy("__place")
    return (
        classified.filter(F.col("bucket").isin(*labels))
        .dropna(subset=LINE_KEY)
        .withColumn("__place", place)
        .withColumn("__rank", F.rank().over(best_first))
        .filter("__rank = 1")
        .drop("__place", "__rank")
    )


def concordance_market(prioritised: DataFrame, focal_class: str) -> DataFrame:
    """Patients and focal share per bucket and month, on each distinct patient row.

    A bucket-month may hold a large part of all rows, so its totals are summed in a group-by
    and joined back instead of being computed in a window over the group.
    """
    row = [*LINE_KEY, "regimen_class", "patients", "bucket"]
    require_columns(prioritised, row, "eligible")
    per_row = prioritised.groupBy(*row).agg(
        F.sum("patients").alias("__patients"),
        F.sum(F.when(F.col("eligible") == 1, F.col("patients"))).alias("__eligible"),
    )
    focal = F.when(F.col("regimen_class") == focal_class, F.col("__patients")).otherwise(0)
    totals = per_row.groupBy("bucket", "month").agg(
        F.sum("__patients").alias("total_patients"),
        F.sum(focal).alias("__focal"),
        F.sum("__eligible").alias("eligible_patients_seen"),
    )
    measured = totals.select(
        "bucket",
        "month",
        "total_patients",
        F.round(ratio(F.col("__focal"), F.col("total_patients")), 4).alias("concordance"),
        "eligible_patients_seen",
    )
    return per_row.select(*row).join(measured, ["bucket", "month"])


def concordance_provider(prioritised: DataFrame, focal_class: str) -> DataFrame:
    """Patients, focal patients and their share per provider, month and bucket."""
    require_columns(prioritised, "provider_id", "month", "bucket", "regimen_class", "eligible")
    patients = F.col("patients")
    focal = F.when(F.col("regimen_class") == focal_class, patients).otherwise(0)
    eligible = F.when(F.col("eligible") == 1, patients).otherwise(0)
    sums = prioritised.groupBy("provider_id", "month", "bucket").agg(
        F.sum(patients).alias("total_patients"),
        F.sum(focal).alias("focal_patients"),
        F.sum(eligible).alias("eligible_patients_seen"),
    )
    share = F.round(ratio(F.col("focal_patients"), F.col("total_patients")), 4)
    return sums.withColumn("concordance", share)


# -- dosing ------------------------------------------------------------------------------

# fixed values: wording of the schedules, and the label of fills that no dosing rule covers
EXPECTED, SHORTER, LONGER = "1 injection in {}", "1 injection in <{}", "1 injection in >{}"
NOT_CATEGORISED = "Non-Categorized"


def _schedule(rules: Sequence[DosingRule], days: Column) -> Column:
    tiers: list[Tier] = []
    for rule in rules:
        applies, expected = rule.applies(), rule.expected_days()
        low, high = expected - rule.tolerance_days, expected + rule.tolerance_days
        weeks = rule.interval_days / 7
        every = f"{weeks:g} week{'' if weeks == 1 else 's'}"
        tiers += [
            (EXPECTED.format(every), applies & (days >= low) & (days <= high)),
            (SHORTER.format(every), applies & (days < low)),
            (LONGER.format(every), applies & (days > high)),
        ]
    return first_match(tiers, NOT_CATEGORISED)


def dosing_schedule(
    episodes: DataFrame, rules: Sequence[DosingRule], min_age: int | None = None
) -> DataFrame:
    """Planned schedule (days of supply) and actual one (days to the next fill) of each fill.

    The age filter comes after the next fill was determined, so a gap may span fills it
    removes. Without a next fill the actual schedule is uncategorised.
    """
    require_columns(
        episodes,
        *["entity_id", "product", "claim_id", "provider_id", "fill_date", "first_date"],
        *["quantity", "strength", "days_supply", "patient_age", "next_fill_date"],
    )
    adults = episodes if min_age is None else episodes.filter(F.col("patient_age") >= min_age)
    to_next = F.datediff("next_fill_date", "fill_date")
    return adults.select(
        *["product", "claim_id", "provider_id", "entity_id", "fill_date", "first_date"],
        *["quantity", "strength", "days_supply"],
        F.datediff("fill_date", "first_date").alias("days_after_first_fill"),
        to_next.alias("days_before_next_fill"),
        _schedule(rules, F.col("days_supply")).alias("dosing"),
        _schedule(rules, to_next).alias("dosing_actual"),
    )


def dosing_consolidated(schedules: Sequence[DataFrame], providers: DataFrame) -> DataFrame:
    """Schedules of several products together, with the provider's specialty."""
    specialty = ["specialty_code", "specialty_name", "specialty_group"]
    require_columns(providers, "provider_id", specialty)
    first, *rest = schedules
    for schedule in rest:
        first = first.unionByName(schedule)
    return first.join(providers.select("provider_id", *specialty), "provider_id", "left")


# -- routes ------------------------------------------------------------------------------

NO_ROUTE = "-"  # fixed value: no rule matches
ROUTE_COLUMNS = ["product", "source", "proc_code", "ndc", "strength", "generic_name"]


def route_rules(
    claims: DataFrame,
    rules: Sequence[RouteRule],
    default: str = NO_ROUTE,
    keep: Names = (),
) -> DataFrame:
    """Route of each claim by the first matching rule, as one CASE expression: no shuffle."""
    require_columns(claims, "claim_id", ROUTE_COLUMNS, keep)
    tiers = [(rule.label, rule.condition()) for rule in rules]
    return claims.select(
        *dict.fromkeys(["claim_id", *ROUTE_COLUMNS, *names(keep)]),
        first_match(tiers, default).alias("route"),
    )


#: Rule columns that a claim must equal where they are filled in.
ROUTE_KEYS = ["product", "source", "proc_code", "ndc", "strength"]


def _first_rules(rules: DataFrame, keys: Sequence[str], has_named: bool) -> DataFrame:
    """One row per key of the rules with what a claim needs to find its first rule.

    ``plain`` is the first rule without a generic name to avoid. ``one`` is the first with such a name;
    ``two`` the first with another one, which is what a claim with the name of ``one`` meets.
    """
    if not has_named:
        return rules.groupBy(*keys).agg(F.min("rule").alias("plain"))
    best = rules.groupBy(*keys, "generic_not").agg(F.min("rule").alias("rule"))
    place = F.row_number().over(Window.partitionBy(*keys, F.col("generic_not").isNull()).orderBy("rule"))
    best = best.withColumn("place", place).where("place <= 2")
    pair = F.struct("rule", "generic_not")
    named = F.col("generic_not").isNotNull()
    return best.groupBy(*keys).agg(
        F.min(F.when(~named, F.col("rule"))).alias("plain"),
        F.min(F.when(named & (F.col("place") == 1), pair)).alias("one"),
        F.min(F.when(named & (F.col("place") == 2), pair)).alias("two"),
    )


def route_by_table(
    claims: DataFrame,
    rules: DataFrame,
    default: str = NO_ROUTE,
    keep: Names = (),
) -> DataFrame:
    """As :func:`route_rules` with the rules in a table, for rule sets too long for a CASE.

    Rule columns: ``priority, product, source, proc_code, ndc, ndc_missing, strength,
    generic_not, label``; NULL matches anything, several codes are several rows. The lowest priority
    counts; of equal ones a rule with a product before one without, then the smaller label.

    Rules are told apart by which columns are filled in. For each combination that occurs (read from the
    rules when this is called, at most 64), the rules become one row per value of those columns, which
    claims meet by an equi-join: a claim is never multiplied, no rules are gathered in a row, and a claim
    looks up one row for each combination, however many rules there are. Catalyst broadcasts a combination's
    rules when they are small enough and splits skewed products when they are not.
    """
    require_columns(claims, "claim_id", ROUTE_COLUMNS, keep)
    require_columns(rules, "priority", ROUTE_KEYS, "ndc_missing", "generic_not", "label")
    order = F.struct("priority", F.col("product").isNull().alias("general"), "label")
    missing = F.coalesce(F.col("ndc_missing"), F.lit(False)).alias("ndc_missing")
    rules = rules.select(*ROUTE_KEYS, "generic_not", missing, order.alias("rule"))
    given = [F.col(c).isNotNull().alias(c) for c in ROUTE_KEYS]
    named = F.max(F.col("generic_not").isNotNull()).alias("has_named")
    masks = rules.select(*given, "ndc_missing", "generic_not").groupBy(*ROUTE_KEYS, "ndc_missing").agg(named)

    found, joined = [], claims
    for i, (*mask, has_named) in enumerate(sorted(map(tuple, masks.collect()))):
        keys = [c for c, is_given in zip(ROUTE_KEYS, mask) if is_given]
        fits = [F.col(c).isNotNull() if g else F.col(c).isNull() for c, g in zip(ROUTE_KEYS, mask)]
        own = _first_rules(rules.where(all_of([*fits, F.col("ndc_missing") == mask[-1]])), keys, has_named)
        row = F.struct("plain", *(("one", "two") if has_named else ())).alias(f"__rules{i}")
        if keys:
            joined = joined.join(own.select(*keys, row), keys, "left")
        else:
            joined = joined.withColumn(f"__rules{i}", own.select(row).scalar())
        row = F.col(f"__rules{i}")
        rule = row["plain"]
        if has_named:
            avoiding = [F.when(F.col("generic_name") != row[c]["generic_not"], row[c]["rule"]) for c in ("one", "two")]
            rule = F.least(rule, *avoiding)
        found.append(F.when(F.col("ndc").isNull(), rule) if mask[-1] else rule)
    nothing = F.lit(None).cast(rules.schema["rule"].dataType)
    label = F.least(nothing, nothing, *found)["label"]
    return joined.select(
        *dict.fromkeys(["claim_id", *ROUTE_COLUMNS, *names(keep)]),
        F.coalesce(label, F.lit(default)).alias("route"),
    )
