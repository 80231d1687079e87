from __future__ import annotations

import pytest
from conftest import rows

from kpiloom.operators import quality


def test_fanout(frame):
    df = frame("a long, b long", (1, 1), (1, 1), (1, 2), (None, 3))
    assert rows(quality.fanout_check(df, "a")) == [(4, 1, 1)]
    assert rows(quality.fanout_check(df, ["a", "b"])) == [(4, 2, 1)]
    assert rows(quality.fanout_check(df, ["a", "b"], approx=True)) == [(4, 2, 1)]
    assert rows(quality.fanout_offenders(df, ["a", "b"])) == [(1, 1, 2)]


def test_join_fanout(frame):
    left = frame("a long", (1,), (2,))
    after = left.join(frame("a long", (1,), (1,), (1,)), "a")
    measured = quality.join_fanout(left, after, "a")
    assert rows(measured) == [(2, 3, 2, 1, 1.5)]


@pytest.mark.parametrize("approx", [False, True])
def test_profile(frame, approx):
    df = frame("n long, t string, d date", (1, None, "2024-01-01"), (1, None, "2023-01-01"), (1, None, None))
    assert rows(quality.profile_table(df, approx)) == [
        (0, "n", "bigint", 3, 0, 1, "1", "1"),
        (1, "t", "string", 3, 3, 0, None, None),
        (2, "d", "date", 3, 1, 2, "2023-01-01", "2024-01-01"),
    ]


def test_grain_finds_the_composite_key(frame):
    df = frame("a long, b long", (1, 1), (1, 2), (2, 1), (2, None))
    assert rows(quality.grain_check(df, ["a", "b", ["a", "b"]])) == [
        ("a", 4, 2, 2, 2, 0), ("a, b", 4, 4, 0, 1, 1), ("b", 4, 3, 1, 2, 0)
    ]
    with pytest.raises(ValueError, match="candidate"):
        quality.grain_check(df, [])


@pytest.mark.parametrize(
    "left, right, shape",
    [([1, 2], [1, 3], "1:1"), ([1, 1], [1], "N:1"), ([1], [1, 1], "1:N"), ([1, 1], [1, 1, 1], "N:M"), ([1, 1], [2], "1:1")],
)
def test_cardinality_shapes(frame, left, right, shape):
    l, r = (frame("k long", *[(k,) for k in side]) for side in (left, right))
    result = quality.join_cardinality(l, r, "k").first()
    assert result.cardinality == shape
    assert result.joined_rows == l.join(r, "k").count()


def test_cardinality_counts_unknown_keys_as_unmatched(frame):
    left = frame("k long", (1,), (None,), (None,), (2,))
    right = frame("k long", (1,), (1,), (None,), (3,))
    result = quality.join_cardinality(left, right, "k").first()
    assert (result.left_rows, result.right_rows, result.joined_rows) == (4, 4, 2)
    assert (result.left_unmatched_rows, result.right_unmatched_rows) == (3, 2)


def test_exclusivity(frame):
    df = frame("id long, s string", (1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None))
    assert rows(quality.segment_exclusivity(df, "id", "s")) == [("none", 1), ("one", 1), ("several", 1)]
    assert rows(quality.segment_counts(df, "s")) == [("a", 3), ("b", 1), (None, 1)]


def test_cardinality_of_hot_keys_goes_past_a_long(spark, frame, monkeypatch):
    # stands for 4e9 rows of one key on each side
    monkeypatch.setattr(quality, "_count_rows", lambda: quality.F.sum("n"))
    side = frame("k long, n long", (1, 4_000_000_000), (2, 4_000_000_000))
    assert quality.join_cardinality(side, side, "k").first().joined_rows == 2 * 4_000_000_000**2
