"""Search over message threads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exprs import (
    DateLike,
    Names,
    any_of,
    between_days,
    contains_any,
    names,
    require_columns,
    today_or,
)
from kpiloom.operators.entity import latest_per_key

FULL_CHAIN, MOST_RECENT = "full_chain", "most_recent"


def thread_search(
    messages: DataFrame,
    subject: Sequence[str] = (),
    participants: Sequence[str] = (),
    keywords: Sequence[str] = (),
    recency_days: int | None = None,
    scope: str = FULL_CHAIN,
    as_of: DateLike | None = None,
    people: Names = "sender",
    recent_only: bool = True,
) -> DataFrame:
    """Messages of the threads with a message that meets every given criterion.

    Within a criterion any of the words is enough; subject and keywords are case-insensitive
    substrings, participants are compared with the columns ``people`` (a text, or an array of
    texts). ``recency_days`` limits the messages that are searched to the last days up to
    ``as_of``, and with ``recent_only`` those that are returned as well. ``full_chain`` returns
    every message of a matching thread, ``most_recent`` its last one.
    """
    require_columns(messages, "thread_id", "seq", "ts", "subject", "text", people)
    if not (subject or participants or keywords):
        raise ValueError("give at least one of subject, participants or keywords")
    if scope not in (FULL_CHAIN, MOST_RECENT):
        raise ValueError(f"unknown scope {scope!r}: use {FULL_CHAIN} or {MOST_RECENT}")
    recent = messages
    if recency_days is not None:
        last = today_or(as_of)
        recent = messages.filter(between_days("ts", last - dt.timedelta(recency_days), last))
    hits = recent
    if subject:
        hits = hits.filter(contains_any("subject", subject))
    if participants:
        wanted = [p.lower() for p in participants]
        hits = hits.filter(any_of(_names_any(messages, c, wanted) for c in names(people)))
    if keywords:
        hits = hits.filter(contains_any("text", keywords))
    threads = hits.select("thread_id").distinct()
    returned = recent if recent_only else messages
    if scope == MOST_RECENT:
        returned = latest_per_key(returned, "thread_id", "ts", "seq")
    return returned.join(threads, "thread_id", "left_semi")


def _names_any(messages: DataFrame, column: str, wanted: Sequence[str]) -> Column:
    if isinstance(messages.schema[column].dataType, T.ArrayType):
        return F.exists(column, lambda p: F.lower(p).isin(*wanted))
    return F.lower(column).isin(*wanted)
