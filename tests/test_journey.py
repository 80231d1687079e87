from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows

from kpiloom.operators import journey

COHORT = [(1, "2024-01-31"), (1, "2024-02-29"), (1, "2024-03-30"), (1, "2024-03-31"),
          (2, "2024-01-15"), (2, "2024-01-15"), (3, "2024-02-10"), (None, "2024-01-01"), (4, None)]


@pytest.mark.parametrize(
    "how, expected",
    [
        ("calendar", [("2024-01-01", 0, 2), ("2024-01-01", 1, 1), ("2024-01-01", 2, 1), ("2024-02-01", 0, 1)]),
        ("whole", [("2024-01-01", 0, 2), ("2024-01-01", 1, 1), ("2024-01-01", 2, 1), ("2024-02-01", 0, 1)]),
        (
            "exact",
            [("2024-01-01", 0.0, 2), ("2024-01-01", 1.0, 1), ("2024-01-01", 1.96774194, 1),
             ("2024-01-01", 2.0, 1), ("2024-02-01", 0.0, 1)],
        ),
    ],
)
def test_cohort_offsets(frame, how, expected):
    df = frame("id long, d date", *COHORT)
    assert rows(journey.cohort(df, "id", "d", how)) == expected


def test_cohort_rejects_unknown_offsets(frame):
    with pytest.raises(ValueError, match="weeks"):
        journey.cohort(frame("id long, d date", (1, "2024-01-01")), "id", "d", "weeks")


def test_funnel_does_not_multiply_on_repeated_ids(frame):
    universe = frame("id long", (1,), (2,), (3,), (3,), (4,))
    steps = [("two", frame("id long", (1,), (1,), (2,), (9,))), ("three", frame("id long", (2,), (3,)))]
    assert rows(journey.funnel_flags(universe, steps, "id")) == [
        (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)
    ]
    assert rows(journey.funnel(universe, steps, "id")) == [(4, 2, 2, 50.0, 100.0)]


def test_funnel_without_entities(frame):
    nobody = frame("id long", (1,)).filter("id > 5")
    assert rows(journey.funnel(nobody, [("two", nobody)], "id")) == [(0, 0, None)]


def test_call_funnel_literal_and_ordered(frame):
    roster = frame("entity_id long", (1,), (1,), (2,), (3,), (4,))
    calls = frame(
        "entity_id long, activity_type string, activity_date date",
        (1, "call", "2024-03-01"), (1, "call", "2024-05-01"), (2, "call", "2024-03-01"),
        (3, "mail", "2024-03-01"), (4, "call", "2023-12-31"), (9, "call", "2024-03-01"),
    )
    claims = frame(
        "entity_id long, service_date date",
        (1, "2024-03-01"), (2, "2024-02-01"), (3, "2024-04-01"), (9, "2024-04-01"),
    )
    literal = journey.call_funnel(roster, calls, claims, "call", "2024-01-01")
    assert rows(literal) == [(4, 2, 2, 50.0, 100.0)]
    ordered = journey.call_funnel(roster, calls, claims, "call", "2024-01-01", ordered=True)
    assert rows(ordered) == [(4, 2, 1, 50.0, 50.0)]


def test_entity_summary_has_one_row_per_entity(frame):
    roster = frame(
        "entity_id long, diagnosis_date date",
        (1, "2024-01-01"), (1, "2024-03-01"), (2, "2022-06-30"), (3, "2024-01-01"), (4, "2022-07-01"),
    )
    customer = frame("entity_id long, name string, region string", (1, "one", "N"), (2, "two", "S"), (4, "four", "S"))
    claims = frame(
        "claim_id long, entity_id long, service_date timestamp, paid_amount double",
        (1, 1, "2024-01-01T00:00:00", 10), (2, 1, "2024-12-31T23:00:00", 5), (3, 1, "2025-01-01T00:00:00", 99),
    )
    calls = frame(
        "entity_id long, activity_date timestamp",
        (1, "2024-02-01T00:00:00"), (1, "2024-02-03T09:00:00"), (4, "2023-02-03T09:00:00"),
    )
    summary = journey.entity_summary(
        roster, claims, calls, customer, "2024-01-01", "2024-12-31", as_of="2024-07-01"
    )
    assert rows(summary) == [
        (1, "one", "N", "2024-03-01", 15.0, 2, 2, "2024-02-03", "Contacted"),
        (4, "four", "S", "2022-07-01", 0.0, 0, 0, None, "Not Contacted"),
    ]


GAPS = [(1, "2024-01-01", 1), (1, "2024-01-01", 2), (1, "2024-02-15", 3), (1, "2024-04-01", 4),
        (1, "2024-06-30", 5), (1, "2024-09-29", 6), (2, "2024-01-01", 7)]


def test_fill_gaps_at_each_limit(frame):
    df = frame("id long, d date, n long", *GAPS)
    picked = ["n", "days_since_prior_fill", "fill_number", "persistence_status"]
    assert rows(journey.fill_gaps(df, "id", "d", "n"), *picked) == [
        (1, None, 1, "Index Fill"), (2, 0, 2, "Continuous"), (3, 45, 3, "Continuous"),
        (4, 46, 4, "Short Gap"), (5, 90, 5, "Short Gap"), (6, 91, 6, "Lapse / Restart"),
        (7, None, 1, "Index Fill"),
    ]


def test_fill_gaps_by_day_counts_a_day_once(frame):
    df = frame("id long, d date, n long", *GAPS)
    picked = ["id", "fill_date", "fills_on_day", "days_since_prior_fill", "fill_number"]
    assert rows(journey.fill_gaps_by_day(df, "id", "d"), *picked)[:2] == [
        (1, "2024-01-01", 2, None, 1), (1, "2024-02-15", 1, 45, 2)
    ]


@pytest.fixture
def cumulative(frame):
    fills = frame(
        "provider_id long, entity_id long, product string, service_date date, new_start int",
        (1, 1, "P", "2024-01-05", 1), (1, 1, "P", "2024-01-09", 1), (1, 2, "P", "2024-02-01", 1),
        (1, 1, "P", "2024-04-01", 1), (1, 3, "P", "2024-04-02", 1), (1, 4, "P", "2024-05-02", 1),
        (1, 5, "P", "2024-06-02", 0), (1, 5, "Q", "2024-06-02", 1), (None, 5, "P", "2024-06-02", 1),
        (2, None, "P", "2024-01-01", 1), (3, 1, "P", "2022-12-31", 1),
    )
    return journey.provider_cumulative(journey.provider_monthly(fills, "P", "2023-01-01"))


def test_provider_months_and_running_total(cumulative):
    picked = ["provider_id", "month", "monthly_new_starts", "cumulative_new_starts"]
    assert rows(cumulative, *picked) == [
        (1, "2024-01-01", 1, 1), (1, "2024-02-01", 1, 2), (1, "2024-04-01", 2, 4), (1, "2024-05-01", 1, 5)
    ]


def test_stage_models(cumulative):
    three = journey.provider_stages(cumulative, **journey.THREE_STAGES)
    assert [r[0] for r in sorted(rows(three, "stage", "month"), key=lambda r: r[1])] == [
        "Trialist", "User", "Adopter", "Adopter"
    ]
    two = journey.provider_stages(cumulative, **journey.TWO_STAGES)
    assert [r[0] for r in sorted(rows(two, "stage", "month"), key=lambda r: r[1])] == [
        "Trialist", None, None, "Adopter"
    ]


def test_episodes_start_with_new_starts(frame):
    fills = frame(
        "entity_id long, product string, claim_id string, provider_id long, strength string, "
        "quantity double, days_supply int, service_date date, new_start int, birth_year int",
        (1, "P", "a", 1, "300", 2, 14, "2024-01-01", 0, 1980),
        (1, "P", "b", 1, "300", 2, 14, "2024-02-01", 1, 0),
        (1, "P", "c", 1, "300", 2, 14, "2024-02-10", 0, 2013),
        (1, "P", "d", 1, "300", 2, 14, "2024-05-01", 1, None),
        (1, "Q", "e", 1, "300", 2, 14, "2024-03-01", None, 1980),
        (1, "P", "f", 1, "300", 2, 14, None, 1, 1980),
    )
    picked = ["claim_id", "next_fill_date", "episode", "first_date", "patient_age"]
    assert rows(journey.fill_episodes(fills, "claim_id"), *picked) == [
        ("a", "2024-02-01", 0, "2024-01-01", 44), ("b", "2024-02-10", 1, "2024-02-01", None),
        ("c", "2024-05-01", 1, "2024-02-01", 11), ("d", None, 2, "2024-05-01", None),
        ("e", None, 0, "2024-03-01", 44),
    ]


def plain_reached(events, steps, days):
    """Steps reached by the entity with these (day, step) events, over all chains."""
    best = 0
    for day, step in events:
        if step != steps[0]:
            continue
        ends = {day}
        for i, s in enumerate(steps):
            if i:
                ends = {d for d, x in events for e in ends if x == s and e <= d <= day + days}
            if not ends:
                break
            best = max(best, i + 1)
    return best


def test_ordered_funnel_against_all_chains(spark):
    rng = random.Random(11)
    base = dt.date(2024, 1, 1)
    steps = ["a", "b", "c", "d"]
    events = [(rng.randrange(60), rng.randrange(40), rng.choice("abcdx")) for _ in range(600)]
    rows_ = [(i, base + dt.timedelta(days=d), s) for i, d, s in events] + [(None, base, "a"), (1, None, "a"), (2, base, None)]
    df = spark.createDataFrame(rows_, "id int, day date, step string")
    for days in (0, 5, 12):
        got = journey.funnel_ordered(df, "id", "day", "step", steps, days).orderBy("step_number").collect()
        reached = [plain_reached([(d, s) for k, d, s in events if k == i], steps, days) for i in range(60)]
        assert [r.entities for r in got] == [sum(n > k for n in reached) for k in range(4)]
        assert got[0].pct_of_previous == got[0].pct_of_first == 100.0
    empty = journey.funnel_ordered(df.limit(0), "id", "day", "step", steps, 5).collect()
    assert [(r.entities, r.pct_of_first) for r in empty] == [(0, None)] * 4


def test_ordered_funnel_takes_a_late_start(frame):
    df = frame("id long, day date, step string", (1, "2024-01-01", "a"), (1, "2024-03-01", "a"), (1, "2024-03-01", "b"), (1, "2024-03-05", "c"))
    got = journey.funnel_ordered(df, "id", "day", "step", ["a", "b", "c"], 7)
    assert [r.entities for r in got.collect()] == [1, 1, 1]


def test_a_patient_counts_once_for_a_provider(frame):
    schema = "provider_id long, entity_id long, product string, service_date date, new_start int"
    df = frame(
        schema, (1, 1, "p", "2024-01-05", 1), (1, 1, "p", "2024-03-01", 1), (1, 2, "p", "2024-03-09", 1),
        (1, 3, "q", "2024-01-01", 1), (1, 4, "p", "2024-01-01", 0), (2, 1, "p", "2024-02-01", 1),
        (1, None, "p", "2024-01-01", 1), (None, 5, "p", "2024-01-01", 1), (1, 6, "p", None, 1),
    )
    got = journey.provider_cumulative_distinct(df, "p")
    assert rows(got) == [(1, "2024-01-01", 1, 1), (1, "2024-03-01", 1, 2), (2, "2024-02-01", 1, 1)]
    assert rows(journey.provider_cumulative_distinct(df, "p", "2024-03-01"))[0] == (1, "2024-03-01", 2, 2)
