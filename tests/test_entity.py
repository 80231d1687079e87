from __future__ import annotations

import pytest
from conftest import rows

from kpiloom.operators import entity, quality


def test_latest_breaks_ties_and_keeps_undated_entities(frame):
    df = frame(
        "id long, d date, n long",
        (1, "2024-01-01", 1), (1, "2024-02-01", 2), (1, "2024-02-01", 3),
        (2, None, 4), (2, "2023-01-01", 5), (3, None, 6), (None, "2024-01-01", 7),
    )
    latest = entity.latest_per_key(df, "id", "d", "n")
    assert rows(latest, "id", "n") == [(1, 3), (2, 5), (3, 6), (None, 7)]
    check = quality.fanout_check(latest, "id").first()
    assert check.total_rows == check.distinct_entities + check.unknown_rows


def test_latest_names_missing_columns(frame):
    with pytest.raises(ValueError, match="missing columns.*when"):
        entity.latest_per_key(frame("id long, d date", (1, None)), "id", "when", "id")


def test_ever_flag_at_each_threshold(frame):
    days = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    df = frame(
        "id long, d timestamp",
        *[(i, f"2024-01-{d:02d}T10:00:00") for i, n in days.items() for d in range(1, n + 1)],
        (2, "2024-01-01T23:00:00"), (6, None),
    )
    result = rows(
        entity.ever_flag(df, "id", "d"),
        "id", "distinct_event_days", "total_events", "classification", "is_trialist", "is_user",
        "is_adopter",
    )
    assert result == [
        (1, 1, 1, "Trialist", 1, 0, 0),
        (2, 2, 3, "User", 1, 1, 0),
        (3, 3, 3, "User", 1, 1, 0),
        (4, 4, 4, "Adopter", 1, 1, 1),
        (5, 5, 5, "Adopter", 1, 1, 1),
        (6, 0, 1, "None", 0, 0, 0),
    ]


def test_top_n_ranks_winners_as_a_full_ranking_would(frame):
    df = frame(
        "id long, v double, s string",
        (1, 10, "a"), (2, 10, "b"), (3, 9, "a"), (4, 8, "b"), (5, 8, "b"), (6, None, "a"),
    )
    top = entity.top_n(df, "id", "v", "s", 4)
    ranks = ["id", "overall_rank", "overall_rank_dense", "rank_within_segment"]
    assert rows(top, *ranks) == [(1, 2, 1, 1), (2, 1, 1, 1), (3, 3, 2, 2), (5, 4, 3, 2)]
    full = rows(entity.rank_all(df, "id", "v", "s"), *ranks)
    assert [r for r in full if r[1] <= 4] == rows(top, *ranks)
    assert entity.top_n(df, "id", "v", "s", 99).count() == 6


@pytest.fixture
def cost_tables(frame):
    claims = frame(
        "claim_id long, entity_id long, service_date timestamp, paid_amount double",
        (1, 1, "2024-01-01T00:00:00", 10), (2, 1, "2024-12-31T10:00:00", 5),
        (3, 2, "2024-06-01T00:00:00", 12), (4, 3, "2024-06-01T00:00:00", 99),
        (5, 4, "2025-01-01T00:00:00", 50), (6, 5, "2024-03-01T00:00:00", 1),
    )
    roster = frame("entity_id long", (1,), (2,), (2,), (4,), (5,))
    customer = frame("entity_id long, name string, region string", (1, "one", "N"), (2, "two", "S"))
    return claims, roster, customer


def test_top_cost_counts_members_once(cost_tables):
    top = entity.top_cost(*cost_tables, "2024-01-01", "2024-12-31", n=2)
    assert rows(top) == [(1, 1, "one", "N", 15.0, 2), (2, 2, "two", "S", 12.0, 1)]


def test_top_cost_per_roster_row_repeats_amounts(cost_tables):
    top = entity.top_cost(*cost_tables, "2024-01-01", "2024-12-31", n=3, per_roster_row=True)
    assert rows(top) == [
        (1, 2, "two", "S", 24.0, 1), (2, 1, "one", "N", 15.0, 2), (3, 5, None, None, 1.0, 1)
    ]


def test_net_new_counts_first_months_only(frame):
    monthly = frame(
        "provider_id long, month date",
        (1, "2024-01-01"), (1, "2024-02-01"), (2, "2024-02-01"), (3, "2024-02-01"), (4, "2024-05-01"),
    )
    assert rows(entity.net_new_list(monthly), "provider_id", "month", "is_net_new") == [
        (1, "2024-01-01", 1), (2, "2024-02-01", 1), (3, "2024-02-01", 1), (4, "2024-05-01", 1)
    ]
    assert rows(entity.net_new_summary(monthly)) == [
        ("2024-01-01", 1, 1), ("2024-02-01", 2, 3), ("2024-05-01", 1, 4)
    ]


def test_detailed_providers_needs_every_condition(frame):
    good = ("P", "FIELD", "VISIT", "OUTBOUND", "BUYER", "2024-03-31T10:00:00")
    variants = [(1, *good), (1, *good)]
    for i, bad in enumerate(["Q", "DESK", "PARCEL", "SUPPLY", "CREW", "2024-04-01T00:00:00"]):
        variants.append((10 + i, *good[:i], bad, *good[i + 1:]))
    variants.append((20, *good[:2], None, *good[3:]))
    df = frame(
        "provider_id long, product string, department string, classification string, "
        "purpose string, contact_type string, activity_date timestamp",
        *variants,
    )
    found = entity.detailed_providers(
        df, "P", "FIELD", ("PARCEL", "FAIR"), "OUTBOUND", "BUYER",
        "2024-01-01", "2024-03-31",
    )
    assert rows(found) == [(1,)]


def test_age_group_writers_ignores_unknown_birth_years(frame):
    df = frame(
        "provider_id long, new_start int, service_date timestamp, birth_year int",
        (1, 1, "2024-12-31T18:00:00", 2013), (2, 1, "2024-06-01T00:00:00", 2012),
        (3, 1, "2024-06-01T00:00:00", 0), (4, 1, "2024-06-01T00:00:00", None),
        (5, 0, "2024-06-01T00:00:00", 2020), (6, 1, "2025-01-01T00:00:00", 2020),
    )
    assert rows(entity.age_group_writers(df, 12, "2024-01-01", "2024-12-31")) == [(1,)]
