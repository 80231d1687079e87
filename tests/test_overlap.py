from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from kpiloom.operators import overlap

CLAIMS = [("N", 1, "x", 2023, 10), ("N", 1, "x", 2024, 20), ("N", 2, "y", 2024, 60),
          ("S", 3, "x", 2023, 5), ("S", 3, "x", 2024, None), (None, 4, "x", 2024, 8)]
SCHEMA = "region string, entity_id long, kind string, y int, v double"


def test_fixed_average_ignores_the_view(frame):
    df = frame(SCHEMA, *CLAIMS)
    view = F.col("y") == 2024
    result = overlap.fixed_average(df, "region", "v", "entity_id", view)
    assert rows(result) == [
        ("N", 2, 40.0, 30.0, 45.0), ("S", 1, None, 5.0, 5.0), (None, 1, 8.0, 8.0, 8.0)
    ]


def test_fixed_average_with_view_dimensions(frame):
    df = frame(SCHEMA, *CLAIMS)
    result = overlap.fixed_average(df, "region", "v", "entity_id", F.col("y") == 2024, "kind")
    assert rows(result) == [
        ("N", "x", 1, 20.0, 30.0, 45.0), ("N", "y", 1, 60.0, 30.0, 45.0),
        ("S", "x", 1, None, 5.0, 5.0), (None, "x", 1, 8.0, 8.0, 8.0),
    ]


def test_product_remap_first_pattern_wins(frame):
    df = frame(
        "entity_id long, product string, service_date date, claim_id long, product_class string, generic_name string",
        (1, "p", "2024-01-01", 1, "c", "aXX"), (1, "p", "2024-01-31", 2, "c", "XXYY"),
        (1, "p", "2024-01-31", 3, None, None), (1, "p", "2024-02-01", 4, "c", "XX"),
    )
    remapped = overlap.product_remap(df, [("XX", "x"), ("YY", "y")], "2024-01-01", "2024-01-31")
    assert rows(remapped, "claim_id", "main_product") == [(1, "x"), (2, "x"), (3, "p")]


def test_market_flags_with_repeated_and_missing_codes(frame):
    fills = frame(
        "entity_id long, product string, service_date date, claim_id long, ndc string",
        *[(1, "p", "2024-01-01", n, ndc) for n, ndc in enumerate(["a", "b", "c", "z", None])],
    )
    lookup = frame(
        "ndc string, market_basket string, product string",
        ("a", "M", "q"), ("a", "M", "w"), ("b", "N", "w"), ("b", None, "w"), ("c", "N", "q"), (None, "M", "w"),
    )
    flagged = overlap.market_flags(fills, lookup, "M", ("w",), "2024-01-01", "2024-01-01")
    assert rows(flagged, "claim_id", "full_market", "sub_market") == [
        (0, 1, 1), (1, 0, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0)
    ]


def test_overlap_needs_both_sides_and_takes_the_latest(frame):
    schema = "entity_id long, product string, service_date date, claim_id long, product_class string"
    a = frame(
        schema,
        (1, "old", "2024-01-01", 9, "k"), (1, "tie1", "2024-02-01", 1, None), (1, "tie2", "2024-02-01", 2, None),
        (2, "only a", "2024-01-01", 1, "k"), (3, "x", None, 1, "k"), (3, "y", "2024-01-01", 2, "m"),
        (4, None, "2024-03-01", 1, "k"), (4, "z", "2024-02-01", 1, "k"),
    )
    b = frame(schema, (1, "b1", "2024-01-01", 1, "k"), (3, "b3", "2024-01-01", 1, "m"), (9, "b9", "2024-01-01", 1, "k"))
    assert rows(overlap.overlap_patients(a, b)) == [(1,), (3,)]
    only = F.col("product_class") == "k"
    recent_a = overlap.recent_products(a, "product", only, "a")
    recent_b = overlap.recent_products(b, "product", only, "b")
    assert rows(recent_a) == [
        (1, "tie2", "old"), (2, "only a", "only a"), (3, "y", "x"), (4, None, None)
    ]
    assert rows(overlap.overlap_recent(recent_a, recent_b)) == [
        (1, "tie2", "old", "b1", "b1"), (3, "y", "x", "b3", None)
    ]
