from __future__ import annotations

import datetime as dt
import random
from itertools import permutations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kpiloom.functions.tiers import AccountRule, DosingRule, RouteRule
from kpiloom.operators import quality, segment


def test_waterfall_first_tier_wins_and_flags_overlap(frame):
    df = frame("id long, a int", (1, 9), (2, 5), (3, 1), (4, None))
    tiers = {"high": F.col("a") > 6, "mid": F.col("a") > 3}
    result = segment.waterfall(df, list(tiers.items()))
    assert rows(result) == [(1, 9, "high", 1, 1), (2, 5, "mid", 0, 1), (3, 1, "Other", 0, 0), (4, None, "Other", 0, 0)]
    exclusive = quality.segment_exclusivity(result, "id", "segment")
    assert rows(exclusive) == [("one", 4)]


def test_waterfall_order_matters(frame):
    df = frame("id long, a int", (1, 9))
    tiers = [("high", F.col("a") > 6), ("mid", F.col("a") > 3), ("low", F.col("a") > 0)]
    for order in permutations(tiers):
        assert segment.waterfall(df, order).first().segment == order[0][0]


def test_comorbidity_segments(frame):
    customer = frame(
        "entity_id long, name string, region string, status string",
        *[(i, f"n{i}", "N", "active") for i in range(1, 5)], (5, "n5", "N", "inactive"),
    )
    a = frame("entity_id long", (1,), (1,), (2,), (5,))
    b = frame("entity_id long", (1,), (3,), (3,))
    result = segment.comorbidity(customer, a, b, a="First", b="Second")
    assert rows(result, "entity_id", "has_a", "has_b", "condition_segment") == [
        (1, 1, 1, "Comorbid"), (2, 1, 0, "First Only"), (3, 0, 1, "Second Only"), (4, 0, 0, "Neither")
    ]
    assert quality.fanout_offenders(result, "entity_id").count() == 0


# -- accounts ----------------------------------------------------------------------------


def test_training_cutoff_turns_in_october():
    assert segment.training_cutoff("2024-09-30") == dt.date(2024, 9, 30)
    assert segment.training_cutoff("2024-10-01") == dt.date(2025, 9, 30)


def providers_of(account: str, trainees: int, others: int, unknown: int = 0, start: int = 0):
    ends = ["2024-10-01"] * trainees + ["2024-09-30"] * others + [None] * unknown
    return [(start + i, account, end) for i, end in enumerate(ends)]


def test_trainee_ratio(frame):
    people = providers_of("A", 1, 2, 1) + providers_of("B", 0, 0, 2, start=10)
    accounts = frame("provider_id long, account_id string", *[p[:2] for p in people], (99, "A"))
    training = frame("provider_id long, training_to date", *[(p[0], p[2]) for p in people])
    result = segment.trainee_ratio(accounts, training, "2024-09-15")
    got = rows(result, "account_id", "trainees", "non_trainees", "known", "providers", "trainee_share")
    assert [r[:5] for r in got] == [("A", 1, 2, 3, 5), ("B", 0, 0, 0, 2)]
    assert [None if r[5] is None else float(r[5]) for r in got] == [0.333333, None]


@pytest.fixture
def segments(frame):
    people = (
        providers_of("share", 5, 25)  # 30 known, 16.7 percent
        + providers_of("few", 5, 24, start=100)  # 29 known
        + providers_of("low", 1499, 8501, start=1000)  # 14.99 percent
        + providers_of("edge", 3, 17, 3, start=20000)  # 15 percent of 20 known
    )
    names = {"share": "Plain", "few": "  Some Network ", "low": "State COLLEGE", "edge": "Else"}
    extra = [
        (1, "forced", "State College"), (2, "ruled", "State College"), (3, "ruled", "State College"),
        (4, "ruled", "Nothing"), (5, "unlisted", None),
    ]
    accounts = frame(
        "provider_id long, account_id string, account_name string, customer_ref string",
        *[(p[0] + 100, p[1], names[p[1]], "r") for p in people], *[(*e, "r") for e in extra],
    )
    training = frame(
        "provider_id long, training_to date", *[(p[0] + 100, p[2]) for p in people]
    )
    hierarchy = accounts.select(
        "provider_id",
        F.when(F.col("provider_id") == 3, "L2").alias("level2_id"),
        F.when(F.col("provider_id") == 2, "L3").alias("level3_id"),
    ).unionByName(frame("provider_id long, level2_id string, level3_id string", (6, None, None)))
    flags = frame(
        "account_id string, label string, flag_a int, flag_b int",
        ("forced", "Z", 1, 0), ("forced", "Community", 0, 1), ("share", "Community", 0, 0),
    )
    organisations = frame(
        "business_name string, facility_type string",
        ("SOME NETWORK", "An Integrated System"), (" some network", "INTEGRATED"), (None, "integrated"),
        ("ELSE", "clinic"),
    )
    rules = [
        AccountRule("Community", "ruled", level3_ids=("L3",)),
        AccountRule("Academic", "ruled", level2_ids=("L2",)),
    ]
    return segment.account_segment(
        hierarchy, accounts, flags, organisations, training, rules, ("college",), "integrated", "2024-09-15"
    )


def test_account_layers(segments):
    label = {r.provider_id: r.account_segment_granular for r in segments.collect()}
    assert [label[i] for i in (1, 2, 3, 4, 5, 6)] == [
        "Community", "Community", "Academic", "Other", "Other", "Other"
    ]
    per_account = {
        r.account_id: r.account_segment_granular
        for r in segments.select("account_id", "account_segment_granular").distinct().collect()
        if r.account_id in ("share", "few", "low", "edge")
    }
    assert per_account == {"share": "Academic", "few": "IDN", "low": "Academic", "edge": "Other"}


def test_account_rollup_and_fanout(segments):
    rolled = segment.account_rollup(segments)
    assert {r.account_segment for r in rolled.filter("provider_id in (1, 2)").collect()} == {"Community"}
    assert {r.account_segment for r in rolled.filter("provider_id > 2").collect()} == {"Non-Community"}
    assert quality.fanout_offenders(rolled, "provider_id").count() == 0


@pytest.mark.parametrize(
    "known, trainees, expected",
    [(30, 5, "Academic"), (29, 5, "Other"), (100, 15, "Academic"), (10000, 1499, "Other")],
)
def test_share_thresholds(frame, known, trainees, expected):
    people = providers_of("A", trainees, known - trainees)
    accounts = frame(
        "provider_id long, account_id string, account_name string, customer_ref string",
        *[(*p[:2], "n", "r") for p in people],
    )
    training = frame("provider_id long, training_to date", *[(p[0], p[2]) for p in people])
    hierarchy = frame("provider_id long, level2_id string, level3_id string", (0, None, None))
    flags = frame("account_id string, label string, flag_a int, flag_b int", ("x", "x", 0, 0))
    networks = frame("business_name string, facility_type string", ("x", "x"))
    result = segment.account_segment(
        hierarchy, accounts, flags, networks, training, [], (), "integrated", "2024-09-15"
    )
    assert result.first().account_segment_granular == expected


# -- therapy lines -----------------------------------------------------------------------

LABELS = {"focal": "focal", "combined": "both", "partner": "partner", "base": "base", "other": "other"}
BUCKETS = ("aa", "ao", "1l", "naive")
LINE_SCHEMA = (
    "patient_id long, provider_id long, regimen string, line int, start_date date, "
    "line_initiation int, first_line_a int, first_line_b int, first_line_focal int"
)


def test_regimen_classes(frame):
    df = frame("regimen string", *[(r,) for r in ("FOC+VEN", "VEN+AC", "VEN", "AC", "ZA", "XX", None)])
    labelled = df.select("regimen", segment.regimen_class("FOC", "VEN", ("AC", "ZA"), LABELS).alias("c"))
    assert dict(rows(labelled)) == {
        "FOC+VEN": "focal", "VEN+AC": "both", "VEN": "partner", "AC": "base", "ZA": "base",
        "XX": "other", None: "other",
    }


@pytest.mark.parametrize(
    "line, a, b, focal, expected",
    [
        (3, 1, 2, None, "aa"), (3, 1, 2, 3, "aa"), (3, 1, 2, 2, None), (3, 1, None, None, "ao"),
        (3, 1, 3, 4, "ao"), (1, None, None, None, "1l"), (1, 1, 1, 1, "1l"), (2, None, 1, None, "naive"),
        (2, 3, None, None, "naive"), (2, 2, None, None, None), (1, 3, None, None, "1l"),
    ],
)
def test_eligibility_buckets(frame, line, a, b, focal, expected):
    df = frame("line int, first_line_a int, first_line_b int, first_line_focal int", (line, a, b, focal))
    assert df.select(segment.eligibility_bucket(BUCKETS)).first()[0] == expected


@pytest.fixture
def classified(frame):
    lines = frame(
        LINE_SCHEMA,
        (1, 7, "FOC", 2, "2024-01-10", 1, None, None, 2),
        (1, 7, "FOC", 2, "2024-01-10", 1, None, None, 2),
        (1, 8, "VEN", 2, "2024-01-31", 1, 1, None, None),
        (1, 8, "XX", 2, "2024-01-31", 1, 1, None, None),
        (2, 7, "AC", 1, "2024-01-05", 1, None, None, None),
        (3, 7, "AC", 1, "2023-12-31", 1, None, None, None),
        (4, 7, "AC", 1, "2022-12-31", 1, None, None, None),
        (5, 7, "AC", 1, "2024-01-05", 0, None, None, None),
        (6, 7, "AC", 2, "2024-01-05", 1, 2, None, None),
        (7, 7, "AC", 1, None, 1, None, None, None),
    )
    regimen = segment.regimen_class("FOC", "VEN", ("AC", "ZA"), LABELS)
    return segment.bucket_classified(
        lines, regimen, segment.eligibility_bucket(BUCKETS), "2024-01-01", "2023-01-15"
    )


def test_bucket_classified(classified):
    picked = ["patient_id", "provider_id", "month", "line", "eligible", "regimen_class", "bucket", "patients"]
    assert rows(classified, *picked) == [
        (1, 7, "2024-01", 2, 1, "focal", "naive", 1),
        (1, 8, "2024-01", 2, 1, "other", "ao", 1),
        (1, 8, "2024-01", 2, 1, "partner", "ao", 1),
        (2, 7, "2024-01", 1, 1, "base", "1l", 1),
        (3, 7, "2023-12", 1, 0, "base", "1l", 1),
    ]


def test_bucket_priority_keeps_ties_and_is_idempotent(classified):
    best = segment.bucket_priority(classified, BUCKETS)
    assert rows(best, "patient_id", "regimen_class", "bucket") == [
        (1, "other", "ao"), (1, "partner", "ao"), (2, "base", "1l"), (3, "base", "1l")
    ]
    assert rows(segment.bucket_priority(best, BUCKETS)) == rows(best)
    # a bucket that is not listed has no priority
    assert rows(segment.bucket_priority(classified, ("naive",)), "patient_id", "bucket") == [(1, "naive")]


def test_concordance(frame):
    best = frame(
        "patient_id long, month string, line int, provider_id long, eligible int, "
        "regimen_class string, bucket string, patients long",
        (1, "2024-01", 1, 7, 1, "focal", "1l", 1), (1, "2024-01", 1, 8, 1, "focal", "1l", 1),
        (2, "2024-01", 1, 7, 0, "base", "1l", 1), (3, "2023-12", 1, 7, 0, "base", "1l", 1),
    )
    market = segment.concordance_market(best, "focal")
    picked = ["patient_id", "month", "total_patients", "concordance", "eligible_patients_seen"]
    assert rows(market, *picked) == [
        (1, "2024-01", 3, 0.6667, 2), (2, "2024-01", 3, 0.6667, 2), (3, "2023-12", 1, 0.0, None)
    ]
    provider = segment.concordance_provider(best, "focal")
    picked = ["provider_id", "month", "total_patients", "focal_patients", "concordance", "eligible_patients_seen"]
    assert rows(provider, *picked) == [
        (7, "2023-12", 1, 0, 0.0, 0), (7, "2024-01", 2, 1, 0.5, 1), (8, "2024-01", 1, 1, 1.0, 1)
    ]


# -- dosing ------------------------------------------------------------------------------

RULES = [DosingRule("P", "40", 2), DosingRule("P", "25", 1.1, whole_doses=False)]
EXPECTED, SHORTER, LONGER = "1 injection in 2 weeks", "1 injection in <2 weeks", "1 injection in >2 weeks"


@pytest.mark.parametrize(
    "strength, quantity, supply, expected",
    [
        ("40 UNITS", 4, 28, EXPECTED), ("40 UNITS", 4, 21, EXPECTED), ("40 UNITS", 4, 35, EXPECTED),
        ("40 UNITS", 4, 20, SHORTER), ("40 units", 4, 36, LONGER), ("40 UNITS", 3, 21, "Non-Categorized"),
        ("25 UNITS", 3, 42, EXPECTED), ("25 UNITS", 3, 34, SHORTER), ("25 UNITS", 3, 50, LONGER),
        ("100 MG", 4, 28, "Non-Categorized"), (None, 4, 28, "Non-Categorized"),
        ("40 UNITS", 4, None, "Non-Categorized"),
    ],
)
def test_dosing_windows(frame, strength, quantity, supply, expected):
    episodes = frame(
        "product string, claim_id long, provider_id long, entity_id long, fill_date date, first_date date, "
        "quantity double, strength string, days_supply int, patient_age int, next_fill_date date",
        ("P", 1, 1, 1, "2024-02-01", "2024-01-01", quantity, strength, supply, 12, None),
    )
    result = segment.dosing_schedule(episodes, RULES, min_age=12)
    assert rows(result, "dosing", "dosing_actual", "days_after_first_fill", "days_before_next_fill") == [
        (expected, "Non-Categorized", 31, None)
    ]


def test_dosing_by_actual_gap_age_filter_and_union(frame):
    episodes = frame(
        "product string, claim_id long, provider_id long, entity_id long, fill_date date, first_date date, "
        "quantity double, strength string, days_supply int, patient_age int, next_fill_date date",
        ("P", 1, 1, 1, "2024-01-01", "2024-01-01", 2, "40", 14, 12, "2024-02-01"),
        ("P", 2, 1, 1, "2024-01-01", "2024-01-01", 2, "40", 14, 11, "2024-02-01"),
        ("P", 3, 1, 1, "2024-01-01", "2024-01-01", 2, "40", 14, None, "2024-02-01"),
        ("Q", 4, 2, 1, "2024-01-01", "2024-01-01", 4, "30", 28, 40, "2024-01-29"),
    )
    first = segment.dosing_schedule(episodes.filter("product = 'P'"), RULES, min_age=12)
    monthly = [DosingRule("Q", "30", 4, interval_days=28)]
    second = segment.dosing_schedule(episodes.filter("product = 'Q'"), monthly, min_age=12)
    providers = frame(
        "provider_id long, specialty_code int, specialty_name string, specialty_group int", (1, 5, "five", 0)
    )
    both = segment.dosing_consolidated([first, second], providers)
    assert rows(both, "claim_id", "dosing", "dosing_actual", "specialty_name") == [
        (1, EXPECTED, LONGER, "five"),
        (4, "1 injection in 4 weeks", "1 injection in 4 weeks", None),
    ]


# -- routes ------------------------------------------------------------------------------

ROUTES = [
    RouteRule("IV", "P", source="MX", proc_codes=("C1", "C2")),
    RouteRule("IV", "P", source="MX", ndcs=("N1",)),
    RouteRule("IV", "P", source="MX", ndc_missing=True, proc_codes=("U1",)),
    RouteRule("IV", "P", source="RX", strengths=("600",)),
    RouteRule("SC", "P"),
    RouteRule("IV", "R", generic_not="BIO"),
    RouteRule("SC", "R"),
    RouteRule("ORAL", "O"),
]


@pytest.fixture
def route_claims(frame):
    return frame(
        "claim_id long, product string, source string, proc_code string, ndc string, strength string, "
        "generic_name string, expected string",
        (1, "P", "MX", "C2", "N9", None, None, "IV"), (2, "P", "MX", None, "N1", None, None, "IV"),
        (3, "P", "MX", "U1", None, None, None, "IV"), (4, "P", "MX", "U1", "N9", None, None, "SC"),
        (5, "P", "RX", "C1", None, "600", None, "IV"), (6, "P", "RX", "C1", None, "300", None, "SC"),
        (7, "P", None, None, None, None, None, "SC"), (8, "R", None, None, None, None, "OTHER", "IV"),
        (9, "R", None, None, None, None, "BIO", "SC"), (10, "R", None, None, None, None, None, "SC"),
        (11, "O", "RX", None, None, None, None, "ORAL"), (12, "Z", "RX", "C1", "N1", "600", None, "-"),
        (13, None, "MX", "C1", None, None, None, "-"),
    )


def test_routes_on_every_branch(route_claims):
    result = segment.route_rules(route_claims, ROUTES, keep="expected")
    assert all(r.route == r.expected for r in result.collect())


def test_route_table_gives_the_same(spark, route_claims):
    lines = [
        (i, r.product, r.source, code, ndc, r.ndc_missing or None, strength, r.generic_not, r.label)
        for i, r in enumerate(ROUTES)
        for code in r.proc_codes or (None,)
        for ndc in r.ndcs or (None,)
        for strength in r.strengths or (None,)
    ]
    table = spark.createDataFrame(
        lines,
        "priority int, product string, source string, proc_code string, ndc string, "
        "ndc_missing boolean, strength string, generic_not string, label string",
    )
    result = segment.route_by_table(route_claims, table, keep="expected")
    assert result.count() == 13
    assert all(r.route == r.expected for r in result.collect())


def test_unknown_patients_have_no_priority(frame):
    rows_of = frame(
        "patient_id long, month string, line int, bucket string",
        (None, "2024-01", 1, "1l"), (None, "2024-01", 1, "ao"), (1, None, 1, "ao"), (1, "2024-01", 1, "1l"),
    )
    assert rows(segment.bucket_priority(rows_of, BUCKETS)) == [(1, "2024-01", 1, "1l")]


def test_route_table_with_rules_for_any_product(spark, route_claims):
    rules = spark.createDataFrame(
        [(2, "P", None, None, None, None, None, None, "own"), (1, None, "MX", None, None, None, None, None, "first"),
         (3, None, None, None, None, None, None, None, "last")],
        "priority int, product string, source string, proc_code string, ndc string, "
        "ndc_missing boolean, strength string, generic_not string, label string",
    )
    claims = spark.createDataFrame(
        [(1, "P", "MX"), (2, "P", "RX"), (3, "Q", "RX"), (4, None, None), (5, None, "MX")],
        "claim_id long, product string, source string",
    ).selectExpr("*", *[f"cast(null as string) AS {c}" for c in ("proc_code", "ndc", "strength", "generic_name")])
    got = segment.route_by_table(claims, rules)
    assert rows(got, "claim_id", "route") == [(1, "first"), (2, "own"), (3, "last"), (4, "last"), (5, "first")]
    only = segment.route_by_table(claims, rules.where("product = 'P'"))
    assert rows(only, "claim_id", "route") == [(1, "own"), (2, "own"), (3, "-"), (4, "-"), (5, "-")]


def test_route_table_against_a_scan_of_all_rules(spark):
    rng = random.Random(9)
    some = lambda values, share: rng.choice(values) if rng.random() < share else None
    rules = [
        (i, some("pqr", 0.8), some("MR", 0.3), some("xyz", 0.3), some("12", 0.2), some((True, False), 0.3), some("st", 0.3), some("gh", 0.5), f"L{i}")
        for i in rng.sample(range(1000), 300)
    ]
    claims = [
        (i, some("pqrv", 0.9), some("MR", 0.9), some("xyz", 0.9), some("123", 0.6), some("st", 0.9), some("ghk", 0.8))
        for i in range(500)
    ]

    def plain(claim):
        _, product, source, proc, ndc, strength, generic = claim
        for _, p, s, c, n, missing, t, avoided, label in sorted(rules):
            pairs = ((p, product), (s, source), (c, proc), (n, ndc), (t, strength))
            if all(rule is None or rule == value for rule, value in pairs) and not (missing and ndc is not None):
                if avoided is None or (generic is not None and generic != avoided):
                    return label
        return "-"

    frame = spark.createDataFrame(claims, "claim_id int, product string, source string, proc_code string, ndc string, strength string, generic_name string")
    schema = "priority int, product string, source string, proc_code string, ndc string, ndc_missing boolean, strength string, generic_not string, label string"
    got = segment.route_by_table(frame, spark.createDataFrame(rules, schema))
    assert {r.claim_id: r.route for r in got.collect()} == {c[0]: plain(c) for c in claims}
    assert len({plain(c) for c in claims}) > 20
    none = segment.route_by_table(frame, spark.createDataFrame([], schema))
    assert {r.route for r in none.collect()} == {"-"}


def test_route_table_of_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr(
        "cast(id AS int) AS priority", "IF(id % 2 = 0, concat('p', id % 1000), NULL) AS product", "'M' AS source",
        "concat('c', id) AS proc_code", "cast(NULL AS string) AS ndc", "false AS ndc_missing", "cast(NULL AS string) AS strength",
        "IF(id % 4 = 1, 'g', NULL) AS generic_not", "concat('L', id) AS label",
    )
    claims = spark.range(20_000).selectExpr(
        "id AS claim_id", "concat('p', (5 * id) % 1000) AS product", "'M' AS source", "concat('c', 5 * id) AS proc_code",
        "'n' AS ndc", "'s' AS strength", "IF(id % 3 = 0, 'g', 'h') AS generic_name",
    )
    routes = {r.claim_id: r.route for r in segment.route_by_table(claims, rules).collect()}
    assert len(routes) == 20_000
    for i, route in routes.items():
        assert route == ("-" if 5 * i % 4 == 1 and i % 3 == 0 else f"L{5 * i}")
