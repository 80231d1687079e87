"""One runnable query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exprs import between_days
from kpiloom.functions.tiers import AccountRule, DosingRule, RouteRule
from kpiloom.operators import (
    audits,
    discovery,
    entity,
    journey,
    overlap,
    profiles,
    quality,
    segment,
    series,
    threads,
)
from kpiloom.plans import kpi
from kpiloom.sources import bindings as b
from kpiloom.sources import stage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def doubles(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, the type reports and the comparison use."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# -- parameters of the queries -----------------------------------------------------------

PRE, POST = ("1999-11-01", "2000-01-31"), ("2000-02-01", "2000-04-30")
PRODUCT = "Brand#7"
PAST = "1999-03-17"
CLASSES_A, CLASSES_B = ("PROMO", "ECONOMY"), ("STANDARD", "LARGE")

LINE_LABELS = {
    "focal": "Focal",
    "combined": "Base and partner",
    "partner": "Partner",
    "base": "Base",
    "other": "Other",
}
BUCKETS = ("After both", "After one", "First line", "Naive")

DOSING = [
    DosingRule("Brand#7", "40", 3),
    DosingRule("Brand#7", "25", 1.4, whole_doses=False),
    DosingRule("Brand#12", "40", 5, interval_days=28),
]

ROUTES = [
    RouteRule("IV", "Brand#1", source="MX", proc_codes=("PROMO", "LARGE")),
    RouteRule("IV", "Brand#1", source="MX", ndc_missing=True, proc_codes=("SMALL",)),
    RouteRule("IV", "Brand#1", source="RX", strengths=("40 UNITS",)),
    RouteRule("SC", "Brand#1"),
    RouteRule("IV", "Brand#2", generic_not="small ring"),
    RouteRule("SC", "Brand#2"),
    RouteRule("ORAL", "Brand#3"),
    RouteRule("IV", "Brand#4", ndcs=("11", "12", "13")),
    RouteRule("SC", "Brand#4"),
]
GENERAL_ROUTES = [
    RouteRule("MAIL", None, source="MX", proc_codes=("PROMO",)),
    *ROUTES,
    RouteRule("OTHER", None, ndc_missing=True),
]
ROUTE_SCHEMA = (
    "priority int, product string, source string, proc_code string, ndc string, "
    "ndc_missing boolean, strength string, generic_not string, label string"
)

ACCOUNT_RULES = [
    AccountRule("Community", "3", level3_ids=("1", "4")),
    AccountRule("Academic", "3", level2_ids=("2",)),
]
ACADEMIC_WORDS = ("university", "research")
FACILITY = "integrated"

SPECS = [
    kpi.KpiSpec(
        "Monthly paid",
        mode=kpi.PATTERN,
        pattern="monthly_trend",
        tables={"claims": "claims"},
        params={"as_of": b.AS_OF},
        value="total_paid",
    ),
    kpi.KpiSpec(
        "Active entities (region)",
        mode=kpi.SQL,
        grain=("region",),
        window=("2000-01-01", "2001-06-30"),
        sql=(
            "SELECT region, trunc(service_date, 'month') AS month,"
            " count(DISTINCT entity_id) AS value FROM {claims} GROUP BY 1, 2"
        ),
    ),
    kpi.KpiSpec(
        "Large claims",
        mode=kpi.RULES,
        grain=("region",),
        window=18,
        table="claims",
        date="service_date",
        measure="sum(paid_amount)",
        filters=("paid_amount >= 100000",),
        exclusions=("region = 'ASIA'", "order_status = 'P'"),
    ),
]


# -- patterns ----------------------------------------------------------------------------


@query
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    latest = entity.latest_per_key(b.claims(spark, d), "entity_id", "service_date", "claim_id")
    return doubles(latest)


@query
def date_spine_fill(spark: SparkSession, d: str) -> DataFrame:
    metric = series.monthly_entities(b.claims(spark, d), "entity_id", "service_date")
    spine = series.month_spine(spark, "1994-11-01", b.AS_OF)
    return series.fill_on_spine(metric, spine, "metric_value")


@query
def date_spine_fill_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "provider_id", "service_date", "l_orderkey")
    metric = series.monthly_entities(rows, "l_orderkey", "service_date", "provider_id")
    return series.fill_months(
        metric, "provider_id", "metric_value", "2000-01-01", b.SHIPPED_AS_OF
    )


@query
def rolling_3m(spark: SparkSession, d: str) -> DataFrame:
    claims = b.claims(spark, d)
    return doubles(series.rolling(claims, "entity_id", "service_date", "paid_amount"))


@query
def rolling_3m_gap_filled(spark: SparkSession, d: str) -> DataFrame:
    claims = b.claims(spark, d)
    return doubles(
        series.rolling(claims, "entity_id", "service_date", "paid_amount", gap_fill=True)
    )


@query
def yoy(spark: SparkSession, d: str) -> DataFrame:
    return series.yoy(b.claims(spark, d), "entity_id", "service_date", b.AS_OF)


@query
def yoy_ytd(spark: SparkSession, d: str) -> DataFrame:
    return series.yoy(b.claims(spark, d), "entity_id", "service_date", b.AS_OF, ytd_aligned=True)


@query
def yoy_past(spark: SparkSession, d: str) -> DataFrame:
    """As of a day inside the data: later rows don't count."""
    return series.yoy(b.claims(spark, d), "entity_id", "service_date", PAST)


@query
def cohort_retention(spark: SparkSession, d: str) -> DataFrame:
    return journey.cohort(b.claims(spark, d), "entity_id", "service_date")


@query
def cohort_whole_months(spark: SparkSession, d: str) -> DataFrame:
    return journey.cohort(b.claims(spark, d), "entity_id", "service_date", "whole")


@query
def cohort_exact_months(spark: SparkSession, d: str) -> DataFrame:
    return journey.cohort(b.claims(spark, d), "entity_id", "service_date", "exact")


def _steps(spark: SparkSession, d: str) -> tuple:
    claims = b.claims(spark, d)
    y1999 = claims.filter(between_days("service_date", "1999-01-01", "1999-12-31"))
    y2000 = claims.filter(between_days("service_date", "2000-01-01", "2000-12-31"))
    y2000 = y2000.filter(F.col("paid_amount") > 200000)
    return b.customer(spark, d), [("step_2_seen", y1999), ("step_3_large", y2000)]


@query
def funnel_steps(spark: SparkSession, d: str) -> DataFrame:
    return journey.funnel(*_steps(spark, d), "entity_id")


@query
def funnel_flags(spark: SparkSession, d: str) -> DataFrame:
    return journey.funnel_flags(*_steps(spark, d), "entity_id")


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    amount, status = F.col("paid_amount"), F.col("order_status")
    tiers = [
        ("Segment A", (amount > 300000) & (status == "F")),
        ("Segment B", amount > 200000),
        ("Segment C", status == "P"),
    ]
    return segment.waterfall(b.claims(spark, d), tiers)


@query
def waterfall_segment(spark: SparkSession, d: str) -> DataFrame:
    return doubles(_segmented(spark, d))


@query
def ever_flag(spark: SparkSession, d: str) -> DataFrame:
    return entity.ever_flag(b.claims(spark, d), ["entity_id", "priority"], "service_date")


@query
def fill_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "entity_id", "service_date", *b.FILL_TIES)
    return journey.fill_gaps(rows, "entity_id", "service_date", b.FILL_TIES)


@query
def fill_gap_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the entities as one, which so holds a fifth of all fills, and unknown ones."""
    rows = b.fills(spark, d, "entity_id", "service_date", *b.FILL_TIES)
    entity_id = F.when(F.col("entity_id") % 5 == 0, 0).when(
        F.col("entity_id") % 5 != 1, F.col("entity_id")
    )
    rows = rows.withColumn("entity_id", entity_id)
    return journey.fill_gaps(rows, "entity_id", "service_date", b.FILL_TIES)


def _one_day(rows: DataFrame) -> DataFrame:
    """A third of the fills as those of one entity on one day, a seventh of all without a date."""
    hot, undated = F.col("l_orderkey") % 3 == 0, F.col("l_orderkey") % 7 == 0
    date = F.when(hot, F.lit("1997-01-01").cast("date")).otherwise(F.col("service_date"))
    return rows.withColumns(
        {
            "entity_id": F.when(hot, 0).otherwise(F.col("entity_id")),
            "service_date": F.when(~undated, date),
        }
    )


@query
def fill_gap_one_day(spark: SparkSession, d: str) -> DataFrame:
    rows = _one_day(b.fills(spark, d, "entity_id", "service_date", *b.FILL_TIES))
    return journey.fill_gaps(rows, "entity_id", "service_date", b.FILL_TIES, split=journey.BY_ORDER)


@query
def fill_gap_by_day(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "entity_id", "service_date")
    return journey.fill_gaps_by_day(rows, "entity_id", "service_date")


@query
def truncation_audit(spark: SparkSession, d: str) -> DataFrame:
    return series.truncation_audit(b.claims(spark, d), "service_date")


@query
def truncation_audit_files(spark: SparkSession, d: str) -> DataFrame:
    """The audit from counts kept for each file: the second call finds nothing left to read."""
    path, store = f"{d}/orders.parquet", stage.new_path(spark)
    audits.update_counts(spark, path, store, "o_orderdate")
    return audits.audit_files(spark, path, store, "o_orderdate")


@query
def actuals_vs_goals(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "provider_id", "service_date", "l_orderkey")
    actual = F.count_distinct("l_orderkey")
    actuals = series.monthly_actuals(rows, "service_date", "provider_id", actual)
    return series.actuals_vs_goals(actuals, b.goals(spark, d), "provider_id")


@query
def actuals_vs_goals_money(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with cents against goals with cents: three quarters of last year's."""
    paid = F.sum("paid_amount")
    actuals = series.monthly_actuals(b.claims(spark, d), "service_date", "order_status", paid)
    goals = actuals.select(
        "order_status",
        F.add_months("month", 12).alias("month"),
        (F.col("actual_value") * F.lit("0.75").cast("decimal(3,2)")).alias("goal_value"),
    )
    return doubles(series.actuals_vs_goals(actuals, goals, "order_status"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return b.claims(spark, d).withColumn("paid", F.round(F.col("paid_amount"), -3))


@query
def topn(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d)
    return doubles(entity.top_n(rows, "claim_id", "paid", "order_status", 100))


@query
def topn_full(spark: SparkSession, d: str) -> DataFrame:
    return doubles(entity.rank_all(_ranked(spark, d), "claim_id", "paid", "order_status"))


# -- worked queries ----------------------------------------------------------------------


@query
def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    return _entity_summary(spark, d, b.AS_OF)


@query
def entity_summary_past(spark: SparkSession, d: str) -> DataFrame:
    return _entity_summary(spark, d, PAST)


def _entity_summary(spark: SparkSession, d: str, as_of: object) -> DataFrame:
    roster = b.roster(spark, d, CLASSES_A, "1998-01-01", "2001-06-30")
    summary = journey.entity_summary(
        roster,
        b.claims(spark, d),
        b.calls(spark, d),
        b.customer(spark, d),
        "2000-01-01",
        "2000-12-31",
        as_of,
    )
    return doubles(summary)


@query
def comorbidity(spark: SparkSession, d: str) -> DataFrame:
    roster_a = b.roster(spark, d, CLASSES_A, "2001-01-01", "2001-03-31")
    roster_b = b.roster(spark, d, CLASSES_B, "2001-02-01", "2001-04-30")
    return segment.comorbidity(b.customer(spark, d), roster_a, roster_b)


@query
def monthly_trend_mom(spark: SparkSession, d: str) -> DataFrame:
    return doubles(series.monthly_trend(b.claims(spark, d), b.AS_OF))


@query
def monthly_trend_past(spark: SparkSession, d: str) -> DataFrame:
    return doubles(series.monthly_trend(b.claims(spark, d), PAST))


@query
def monthly_trend_past_filled(spark: SparkSession, d: str) -> DataFrame:
    return doubles(series.monthly_trend(b.claims(spark, d), PAST, gap_fill=True))


@query
def monthly_trend_by_region(spark: SparkSession, d: str) -> DataFrame:
    claims, places = b.claims(spark, d), b.customer(spark, d)
    return doubles(
        series.monthly_trend(
            claims, b.AS_OF, months=18, by="region", gap_fill=True, places=places
        )
    )


def _top_cost(spark: SparkSession, d: str, **options: bool) -> DataFrame:
    roster = b.roster(spark, d, CLASSES_A, "2001-01-01", "2001-06-30")
    claims, customer = b.claims(spark, d), b.customer(spark, d)
    return doubles(
        entity.top_cost(claims, roster, customer, "2000-01-01", "2000-12-31", **options)
    )


@query
def top_cost(spark: SparkSession, d: str) -> DataFrame:
    return _top_cost(spark, d)


@query
def top_cost_per_roster_row(spark: SparkSession, d: str) -> DataFrame:
    return _top_cost(spark, d, per_roster_row=True)


def _call_funnel(spark: SparkSession, d: str, **options: bool) -> DataFrame:
    roster = b.roster(spark, d, CLASSES_A, "2000-01-01", "2001-06-30")
    return journey.call_funnel(
        roster, b.calls(spark, d), b.claims(spark, d), "click", "2000-06-01", **options
    )


@query
def call_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _call_funnel(spark, d)


@query
def call_funnel_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _call_funnel(spark, d, ordered=True)


FUNNEL = ["signup", "view", "click", "purchase"]


@query
def funnel_ordered(spark: SparkSession, d: str) -> DataFrame:
    return journey.funnel_ordered(b.calls(spark, d), "entity_id", "activity_date", "activity_type", FUNNEL, 90)


@query
def rolling_3m_range(spark: SparkSession, d: str) -> DataFrame:
    return doubles(series.rolling_range(b.claims(spark, d), "service_date", "paid_amount"))


@query
def fixed_lod_avg(spark: SparkSession, d: str) -> DataFrame:
    claims, places = b.claims(spark, d), b.customer(spark, d)
    in_view = F.year("service_date") == 2000
    return overlap.fixed_average(
        claims, "region", "paid_amount", "entity_id", in_view, "order_status", places
    )


def _rolling_6m(spark: SparkSession, d: str, **options: bool) -> DataFrame:
    rows = b.fills(spark, d, "provider_id", "product", "service_date", "new_start")
    return series.rolling_new_starts(rows, PRODUCT, "2000-01-01", "2001-03-31", **options)


@query
def rolling_6m(spark: SparkSession, d: str) -> DataFrame:
    return _rolling_6m(spark, d)


@query
def rolling_6m_warmup(spark: SparkSession, d: str) -> DataFrame:
    return _rolling_6m(spark, d, warmup=True)


@query
def period_growth_entity(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "provider_id", "product", "service_date", "new_start")
    ours = F.col("product") == PRODUCT
    return series.period_growth(rows, "service_date", "new_start", PRE, POST, "provider_id", ours)


@query
def period_growth_market(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "product", "service_date", "new_start")
    ours = F.col("product") == PRODUCT
    return series.period_growth(rows, "service_date", "new_start", PRE, POST, where=ours)


@query
def trainee_ratio(spark: SparkSession, d: str) -> DataFrame:
    return doubles(
        segment.trainee_ratio(b.provider_account(spark, d), b.training(spark, d), b.AS_OF)
    )


@query
def account_segment(spark: SparkSession, d: str) -> DataFrame:
    return segment.account_segment(
        b.provider_hierarchy(spark, d),
        b.provider_account(spark, d),
        b.account_flags(spark, d),
        b.organisations(spark, d),
        b.training(spark, d),
        ACCOUNT_RULES,
        ACADEMIC_WORDS,
        FACILITY,
        b.AS_OF,
    )


@query
def account_rollup(spark: SparkSession, d: str) -> DataFrame:
    return segment.account_rollup(account_segment(spark, d))


@query
def bucket_classified(spark: SparkSession, d: str) -> DataFrame:
    regimen = segment.regimen_class(
        "LARGE", "Brand#1", ("PROMO", "ECONOMY", "STANDARD"), LINE_LABELS
    )
    return segment.bucket_classified(
        b.therapy_lines(spark, d),
        regimen,
        segment.eligibility_bucket(BUCKETS),
        eligible_from="1996-12-01",
        floor="1995-06-01",
    )


@query
def bucket_priority(spark: SparkSession, d: str) -> DataFrame:
    return segment.bucket_priority(bucket_classified(spark, d), BUCKETS)


@query
def bucket_priority_unknown(spark: SparkSession, d: str) -> DataFrame:
    """With unknown patients, which are no one's rows and left out."""
    known = F.when(F.col("patient_id") % 10 != 0, F.col("patient_id"))
    classified = bucket_classified(spark, d).withColumn("patient_id", known)
    return segment.bucket_priority(classified, BUCKETS)


@query
def concordance_market(spark: SparkSession, d: str) -> DataFrame:
    return segment.concordance_market(bucket_priority(spark, d), LINE_LABELS["focal"])


@query
def concordance_provider(spark: SparkSession, d: str) -> DataFrame:
    return segment.concordance_provider(bucket_priority(spark, d), LINE_LABELS["focal"])


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(
        spark, d, "provider_id", "entity_id", "product", "service_date", "new_start"
    )
    return journey.provider_monthly(rows, PRODUCT, "1996-01-01")


@query
def provider_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _monthly(spark, d)


@query
def provider_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return journey.provider_cumulative(_monthly(spark, d))


@query
def provider_cumulative_distinct(spark: SparkSession, d: str) -> DataFrame:
    columns = ["provider_id", "entity_id", "product", "service_date", "new_start"]
    return journey.provider_cumulative_distinct(b.fills(spark, d, *columns), PRODUCT, "1996-01-01")


@query
def stage_3bucket(spark: SparkSession, d: str) -> DataFrame:
    return journey.provider_stages(provider_cumulative(spark, d), **journey.THREE_STAGES)


@query
def stage_2bucket(spark: SparkSession, d: str) -> DataFrame:
    return journey.provider_stages(provider_cumulative(spark, d), **journey.TWO_STAGES)


@query
def net_new_list(spark: SparkSession, d: str) -> DataFrame:
    return entity.net_new_list(_monthly(spark, d))


@query
def net_new_summary(spark: SparkSession, d: str) -> DataFrame:
    return entity.net_new_summary(_monthly(spark, d))


def _episodes(
    spark: SparkSession, d: str, products: list[str], one_entity: bool = False, one_day: bool = False
) -> DataFrame:
    columns = (
        "entity_id product claim_id provider_id strength quantity days_supply service_date "
        "new_start birth_year"
    ).split()
    rows = b.fills(spark, d, *columns, *b.FILL_TIES)
    if one_entity:  # a fifth of the entities as one
        rows = rows.withColumn("entity_id", F.when(F.col("entity_id") % 5 == 0, 0).otherwise(F.col("entity_id")))
    if one_day:
        rows = _one_day(rows)
    split = journey.BY_ORDER if one_day else journey.BY_DAY
    return journey.fill_episodes(
        rows, b.FILL_TIES, "1996-04-01", F.col("product").isin(*products), split
    )


@query
def fill_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d, ["Brand#7", "Brand#12"])


@query
def fill_episodes_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d, ["Brand#7", "Brand#12"], one_entity=True)


@query
def fill_episodes_one_day(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d, ["Brand#7", "Brand#12"], one_day=True)


@query
def dosing_schedule(spark: SparkSession, d: str) -> DataFrame:
    return segment.dosing_schedule(_episodes(spark, d, ["Brand#7", "Brand#12"]), DOSING, 9)


@query
def dosing_consolidated(spark: SparkSession, d: str) -> DataFrame:
    # the rules of all products in one pass; separate schedules would each read the fills
    return segment.dosing_consolidated([dosing_schedule(spark, d)], b.providers(spark, d))


def _route_claims(spark: SparkSession, d: str) -> DataFrame:
    columns = ["claim_id", *segment.ROUTE_COLUMNS, "provider_id", "service_date"]
    return b.fills(spark, d, *columns)


@query
def route_rules(spark: SparkSession, d: str) -> DataFrame:
    return segment.route_rules(
        _route_claims(spark, d), ROUTES, keep=["provider_id", "service_date"]
    )


def _route_table(spark: SparkSession, rules: list[RouteRule] = ROUTES) -> DataFrame:
    lines = [
        (i, r.product, r.source, code, ndc, r.ndc_missing, strength, r.generic_not, r.label)
        for i, r in enumerate(rules)
        for code in r.proc_codes or (None,)
        for ndc in r.ndcs or (None,)
        for strength in r.strengths or (None,)
    ]
    return spark.createDataFrame(lines, ROUTE_SCHEMA)


@query
def route_rules_table(spark: SparkSession, d: str) -> DataFrame:
    return segment.route_by_table(
        _route_claims(spark, d), _route_table(spark), keep=["provider_id", "service_date"]
    )


@query
def route_rules_general(spark: SparkSession, d: str) -> DataFrame:
    """A table with rules for any product, before and after those of products."""
    rules = _route_table(spark, GENERAL_ROUTES)
    return segment.route_by_table(
        _route_claims(spark, d), rules, keep=["provider_id", "service_date"]
    )


@query
def detailed_providers(spark: SparkSession, d: str) -> DataFrame:
    return entity.detailed_providers(
        b.calls(spark, d),
        product="Brand#5",
        department="FIELD",
        excluded_classes=("PARCEL", "FAIR"),
        purpose="OUTBOUND",
        contact_type="BUYER",
        first="1996-01-01",
        last="2000-12-31",
    )


@query
def age_group_writers(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "provider_id", "new_start", "service_date", "birth_year")
    return entity.age_group_writers(rows, 9, "1999-04-01", "2000-03-31")


def _population_a(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(
        spark, d, *"entity_id product service_date claim_id product_class generic_name".split()
    )
    patterns = [("ring", "Rings"), ("widget", "Widgets"), ("bolt", "Bolts")]
    kept = F.col("product_class").isin(*CLASSES_A)
    return overlap.product_remap(rows, patterns, "2001-01-01", "2001-03-31", kept)


def _population_b(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(
        spark, d, *"entity_id product service_date claim_id ndc product_class".split()
    )
    return overlap.market_flags(
        rows,
        b.product_lookup(spark, d),
        "LARGE",
        ("Brand#3", "Brand#7"),
        "2001-02-01",
        "2001-04-30",
        F.col("product_class").isin(*CLASSES_B),
    )


def _recent_a(spark: SparkSession, d: str) -> DataFrame:
    only = F.col("product_class") == "PROMO"
    return overlap.recent_products(_population_a(spark, d), "main_product", only, "a")


def _recent_b(spark: SparkSession, d: str) -> DataFrame:
    only = F.col("sub_market") == 1
    return overlap.recent_products(_population_b(spark, d), "product", only, "b")


@query
def product_remap(spark: SparkSession, d: str) -> DataFrame:
    return _population_a(spark, d)


@query
def market_flags(spark: SparkSession, d: str) -> DataFrame:
    return _population_b(spark, d)


@query
def overlap_patients(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_patients(_population_a(spark, d), _population_b(spark, d))


@query
def recent_products_a(spark: SparkSession, d: str) -> DataFrame:
    return _recent_a(spark, d)


@query
def recent_products_b(spark: SparkSession, d: str) -> DataFrame:
    return _recent_b(spark, d)


@query
def overlap_recent(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_recent(_recent_a(spark, d), _recent_b(spark, d))


# -- checks, KPIs and search -------------------------------------------------------------


@query
def fanout_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.fanout_check(b.fills(spark, d, "entity_id", "service_date"), "entity_id")


@query
def fanout_offenders(spark: SparkSession, d: str) -> DataFrame:
    return quality.fanout_offenders(b.claims(spark, d), ["entity_id", "service_date"])


@query
def join_fanout(spark: SparkSession, d: str) -> DataFrame:
    claims = b.claims(spark, d)
    lines = b.fills(spark, d, "l_orderkey", "l_linenumber", "l_partkey")
    lines = lines.withColumnRenamed("l_orderkey", "claim_id")
    joined = lines.join(claims, "claim_id")
    return quality.join_fanout(claims, joined, "claim_id")


@query
def profile_table(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile_table(b.table(spark, d, "orders"))


@query
def grain_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.grain_check(
        b.table(spark, d, "lineitem"),
        ["l_orderkey", ["l_orderkey", "l_linenumber"], [*b.FILL_TIES, "l_shipdate"]],
    )


@query
def join_cardinality(spark: SparkSession, d: str) -> DataFrame:
    calls = b.calls(spark, d)
    return doubles(quality.join_cardinality(b.claims(spark, d), calls, "entity_id"))


GRAIN_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate"]


@query
def grain_discover(spark: SparkSession, d: str) -> DataFrame:
    found = [
        discovery.grain_discover(b.table(spark, d, name), columns).withColumn("table_name", F.lit(name))
        for name, columns in (("lineitem", GRAIN_COLUMNS), ("orders", None), ("nation", None))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _join_keys(spark: SparkSession, d: str, left: str, right: str, least: float) -> DataFrame:
    found = discovery.join_keys(b.table(spark, d, left), b.table(spark, d, right), least)
    return found.withColumns({"left_table": F.lit(left), "right_table": F.lit(right)})


@query
def join_keys(spark: SparkSession, d: str) -> DataFrame:
    pairs = (("orders", "customer"), ("lineitem", "part"), ("customer", "nation"))
    one, two, three = (_join_keys(spark, d, *p, 1.0) for p in pairs)
    return one.unionByName(two).unionByName(three)


@query
def join_keys_partial(spark: SparkSession, d: str) -> DataFrame:
    return _join_keys(spark, d, "events", "customer", 0.5)


@query
def fanout_heavy_keys(spark: SparkSession, d: str) -> DataFrame:
    return discovery.heavy_keys(b.fills(spark, d, "entity_id", "provider_id"), "entity_id", top=25)


@query
def profile_merged(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders")
    parts = profiles.profile_sketches(orders.withColumn("part", F.year("o_orderdate")), by="part")
    report = profiles.profile_report(profiles.merge_profiles(parts))
    exact = quality.profile_table(orders).select("position", "distinct_count")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    close = F.when(off <= 0.04 * F.col("distinct_count") + 1, 1).otherwise(0)
    return report.join(exact, "position").select(
        *["position", "column_name", "data_type", "row_count", "null_count", "min_value", "max_value"],
        close.alias("distinct_is_close"),
    )


@query
def freshness(spark: SparkSession, d: str) -> DataFrame:
    rows = b.fills(spark, d, "service_date")
    return series.freshness(rows, "service_date", "2001-12-31")


@query
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.segment_counts(_segmented(spark, d), "segment")


@query
def segment_exclusivity(spark: SparkSession, d: str) -> DataFrame:
    return quality.segment_exclusivity(_segmented(spark, d), "entity_id", "segment")


@query
def kpi_run(spark: SparkSession, d: str) -> DataFrame:
    tables = {"claims": b.claims(spark, d, with_region=True)}
    return kpi.run_kpis(spark, SPECS, tables, b.AS_OF)


@query
def kpi_consistency(spark: SparkSession, d: str) -> DataFrame:
    return kpi.kpi_consistency(kpi_run(spark, d))


@query
def kpi_missing(spark: SparkSession, d: str) -> DataFrame:
    return kpi.kpi_missing(kpi_run(spark, d), SPECS)


def _described(name: str, measure: str, grain: tuple[str, ...] = (), **rules) -> kpi.KpiSpec:
    return kpi.KpiSpec(name, mode=kpi.RULES, grain=grain, table="claims", date="service_date", measure=measure, **rules)


DESCRIBED_SPECS = [
    _described("Paid", "sum(paid_amount)"),
    _described("Paid in region", "sum(paid_amount)", ("region",), exclusions=("order_status = 'P'",)),
    _described("Active entities", "count(DISTINCT entity_id)", ("region",), window=("2000-01-01", "2001-06-30")),
    _described("Largest claim", "max(paid_amount)", ("region", "order_status"), filters=("paid_amount < 200000",)),
    _described("Statuses in use", "count(DISTINCT order_status)", ("order_status",), window=12),
    _described("Urgent claims", "count(*)", filters=("priority = '1-URGENT'",), columns=("priority",)),
]


@query
def kpi_run_one_pass(spark: SparkSession, d: str) -> DataFrame:
    """Six KPIs of four grains over one table, which is read once."""
    return kpi.run_kpis(spark, DESCRIBED_SPECS, {"claims": b.claims(spark, d, with_region=True)}, b.AS_OF)


PATTERN_SPECS = [
    kpi.KpiSpec(
        "Change on last year",
        mode=kpi.PATTERN,
        grain=("entity_id",),
        pattern="yoy",
        tables={"df": "claims"},
        params={"id": "entity_id", "date": "service_date", "as_of": b.AS_OF},
        value="yoy_abs_change",
        period=None,
    ),
    kpi.KpiSpec(
        "Claims funnel",
        mode=kpi.PATTERN,
        pattern="funnel",
        tables={"universe": "customers", "steps": (("with_claim", "claims"), ("segmented", "segmented"))},
        params={"id": "entity_id"},
        value="with_claim",
        period=None,
    ),
    kpi.KpiSpec(
        "Largest claims",
        mode=kpi.PATTERN,
        grain=("order_status", "claim_id"),
        pattern="topn",
        tables={"df": "ranked"},
        params={"id": "claim_id", "value": "paid", "segment": "order_status", "n": 20},
        value="overall_rank",
        period=None,
    ),
    kpi.KpiSpec(
        "Concordance",
        mode=kpi.PATTERN,
        grain=("bucket", "patient_id", "line", "regimen_class"),
        pattern="concordance_market",
        tables={"prioritised": "prioritised"},
        params={"focal_class": LINE_LABELS["focal"]},
        value="concordance",
        period="month",
    ),
    kpi.KpiSpec(
        "Segments",
        mode=kpi.PATTERN,
        grain=("segment",),
        pattern="segment_counts",
        tables={"df": "segmented"},
        params={"segment": "segment"},
        value="n",
        period=None,
    ),
]


@query
def kpi_run_patterns(spark: SparkSession, d: str) -> DataFrame:
    """KPIs of patterns with and without a period, one of them over a list of tables."""
    tables = {
        "claims": b.claims(spark, d),
        "customers": b.customer(spark, d).where("status = 'active'"),
        "segmented": _segmented(spark, d),
        "ranked": _ranked(spark, d),
        "prioritised": bucket_priority(spark, d),
    }
    return kpi.run_kpis(spark, PATTERN_SPECS, tables, b.AS_OF)


SEARCH = {"keywords": ("heon", "eaux"), "participants": ("user", "system")}


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        "thread_id", "seq", F.to_date("ts").alias("sent_date"), "sender", "subject", "text"
    )


@query
def thread_search(spark: SparkSession, d: str) -> DataFrame:
    return _shown(
        threads.thread_search(
            b.messages(spark, d), **SEARCH, recency_days=30, as_of="2024-02-01"
        )
    )


@query
def thread_search_whole(spark: SparkSession, d: str) -> DataFrame:
    """Threads with a recent hit, with their older messages."""
    return _shown(
        threads.thread_search(
            b.messages(spark, d),
            **SEARCH,
            recency_days=30,
            as_of="2024-02-01",
            people=["sender", "subject"],
            recent_only=False,
        )
    )


@query
def thread_latest(spark: SparkSession, d: str) -> DataFrame:
    return _shown(
        threads.thread_search(
            b.messages(spark, d), subject=("th", "de"), **SEARCH, scope=threads.MOST_RECENT
        )
    )
