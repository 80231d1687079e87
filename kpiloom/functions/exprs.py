"""Column expressions and date arithmetic shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DateLike = dt.date | str
Names = str | Sequence[str]


def names(cols: Names) -> list[str]:
    """One column name or several, as a list."""
    return [cols] if isinstance(cols, str) else list(cols)


def require_columns(df: DataFrame, *cols: Names | None) -> None:
    """Raise with the full list of missing columns before any plan is built on them."""
    wanted = [c for group in cols if group is not None for c in names(group)]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


# -- dates -------------------------------------------------------------------------------


def to_day(value: DateLike) -> dt.date:
    """A Python date from a date, a datetime or ISO text."""
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def today_or(as_of: DateLike | None) -> dt.date:
    """The reference date: the one given, or today on the driver (UTC)."""
    return to_day(as_of) if as_of is not None else dt.datetime.now(dt.timezone.utc).date()


def month_start(day: DateLike) -> dt.date:
    return to_day(day).replace(day=1)


def shift_months(day: DateLike, months: int) -> dt.date:
    """Calendar shift that clamps to the last day of the month, as ``add_months`` does."""
    day = to_day(day)
    index = day.year * 12 + day.month - 1 + months
    first = dt.date(index // 12, index % 12 + 1, 1)
    after = dt.date((index + 1) // 12, (index + 1) % 12 + 1, 1)
    return first.replace(day=min(day.day, (after - first).days))


def day_of(column: str | Column) -> Column:
    return F.to_date(column)


def month_of(column: str | Column) -> Column:
    """First day of the month as a DATE (``date_trunc`` would give a timestamp)."""
    return F.trunc(F.to_date(column), "month")


def between_days(column: str, first: DateLike, last: DateLike) -> Column:
    """Whole days from ``first`` to ``last``, both included, whatever the time of day.

    Compares the raw column through a cast, which Catalyst unwraps, so the range reaches the
    Parquet scan.
    """
    return (day_of(column) >= F.lit(to_day(first))) & (day_of(column) <= F.lit(to_day(last)))


def in_months(column: str, first: DateLike, last: DateLike) -> Column:
    """Whole months from ``first`` to ``last`` as a half-open day range.

    A predicate on a truncated month is opaque to Parquet statistics, this one is not.
    """
    after = shift_months(month_start(last), 1)
    return (day_of(column) >= F.lit(month_start(first))) & (day_of(column) < F.lit(after))


def months_apart(later: Column, earlier: Column, how: str = "calendar") -> Column:
    """Months from ``earlier`` to ``later``.

    ``calendar`` counts month boundaries, ``whole`` counts completed months, ``exact`` keeps
    the fraction.
    """
    if how == "calendar":
        years = (F.year(later) - F.year(earlier)) * 12
        return (years + F.month(later) - F.month(earlier)).cast("int")
    if how == "whole":
        return F.floor(F.months_between(later, earlier)).cast("int")
    if how == "exact":
        return F.months_between(later, earlier)
    raise ValueError(f"unknown month offset {how!r}: use calendar, whole or exact")


# -- numbers and flags -------------------------------------------------------------------


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; NULL where the base is zero or NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def pct(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """``part`` as a percentage of ``whole``, rounded; NULL where the base is zero or NULL."""
    value = part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def or_zero(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_any(column: str | Column, words: Iterable[str]) -> Column:
    """Case-insensitive substring search for any of the words."""
    text = F.lower(column)
    return any_of(text.contains(word.lower()) for word in words)


def slug(column: str | Column) -> Column:
    """Lower-case text with every run of other characters as one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), F.lit("-"))
