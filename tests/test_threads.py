from __future__ import annotations

import pytest
from conftest import rows

from kpiloom.operators.threads import MOST_RECENT, thread_search


@pytest.fixture
def messages(frame):
    return frame(
        "thread_id long, seq long, ts timestamp, sender string, subject string, text string",
        (1, 0, "2024-01-01T08:00:00", "ann", "Budget plan", "hello"),
        (1, 1, "2024-01-02T08:00:00", "bob", "Budget plan", "the TARGET moved"),
        (1, 2, "2024-01-03T08:00:00", "ann", "Budget plan", "ok"),
        (2, 0, "2024-01-01T08:00:00", "bob", "Lunch", "target practice"),
        (3, 0, "2023-06-01T08:00:00", "bob", "Budget old", "target"),
        (4, 0, "2024-01-03T08:00:00", None, None, None),
    )


def test_keyword_in_a_middle_message_returns_the_chain(messages):
    found = thread_search(messages, subject=["budget"], keywords=["target"])
    assert rows(found, "thread_id", "seq") == [(1, 0), (1, 1), (1, 2), (3, 0)]


def test_latest_message_only(messages):
    found = thread_search(messages, subject=["budget"], keywords=["target"], scope=MOST_RECENT)
    assert rows(found, "thread_id", "seq") == [(1, 2), (3, 0)]


def test_recency_excludes_a_thread(messages):
    found = thread_search(messages, keywords=["target"], recency_days=2, as_of="2024-01-04")
    assert rows(found, "thread_id", "seq") == [(1, 1), (1, 2)]


def test_participants_and_any_word(messages):
    assert rows(thread_search(messages, participants=["BOB"]), "thread_id", "seq") == [
        (1, 0), (1, 1), (1, 2), (2, 0), (3, 0)
    ]
    found = thread_search(messages, keywords=["practice", "moved"])
    assert {r.thread_id for r in found.collect()} == {1, 2}


def test_criteria_are_required(messages):
    with pytest.raises(ValueError, match="at least one"):
        thread_search(messages)
    with pytest.raises(ValueError, match="scope"):
        thread_search(messages, keywords=["x"], scope="some")


def test_words_late_in_a_long_subject_are_found(frame):
    late = "x " * 60 + "budget"
    df = frame(
        "thread_id long, seq long, ts timestamp, sender string, subject string, text string",
        (1, 0, "2024-01-01T08:00:00", "ann", late, "hello"),
    )
    assert rows(thread_search(df, subject=["budget"]), "thread_id") == [(1,)]


def test_recency_of_the_search_alone(messages):
    found = thread_search(
        messages, keywords=["ok"], recency_days=1, as_of="2024-01-04", recent_only=False
    )
    assert rows(found, "thread_id", "seq") == [(1, 0), (1, 1), (1, 2)]


def test_messages_after_the_reference_date_are_not_searched(messages):
    assert rows(thread_search(messages, keywords=["ok"], recency_days=9, as_of="2024-01-02")) == []


def test_participants_in_several_columns(messages):
    from pyspark.sql import functions as F

    more = messages.withColumn("copied", F.when(F.col("thread_id") == 2, F.array(F.lit("Zoe"))))
    found = thread_search(more, participants=["zoe"], people=["sender", "copied"])
    assert rows(found, "thread_id", "seq") == [(2, 0)]
