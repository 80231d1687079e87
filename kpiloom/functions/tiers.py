"""First-match-wins classification: tiers of conditions and nullable rule tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiloom.functions.exprs import all_of

Tier = tuple[str, Column]


def first_match(tiers: Sequence[Tier], default: str | None = None) -> Column:
    """Label of the first tier whose condition is true; the default when none is.

    An unknown (NULL) condition does not match, so the row falls through to the next tier.
    """
    if not tiers:
        return F.lit(default).cast("string")
    (label, condition), *rest = tiers
    chain = F.when(condition, F.lit(label))
    for label, condition in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default)) if default is not None else chain


def first_match_column(tiers: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """As :func:`first_match` with the outcome given as a column instead of a fixed label."""
    chain = None
    for outcome, condition in tiers:
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    return default if chain is None else chain.otherwise(default)


def at_least(column: str, thresholds: Iterable[tuple[str, int]]) -> list[Tier]:
    """Tiers ``column >= n``, highest threshold first."""
    ordered = sorted(thresholds, key=lambda item: -item[1])
    return [(label, F.col(column) >= n) for label, n in ordered]


@dataclass(frozen=True)
class RouteRule:
    """One line of a routing table: every column that is filled in must match.

    ``None`` and empty tuples match anything. ``ndc_missing`` asks for a NULL package code.
    ``generic_not`` is a plain ``<>``: an unknown generic name does not match it.
    """

    label: str
    product: str | None = None
    source: str | None = None
    proc_codes: tuple[str, ...] = ()
    ndcs: tuple[str, ...] = ()
    ndc_missing: bool = False
    strengths: tuple[str, ...] = ()
    generic_not: str | None = None

    def condition(self) -> Column:
        terms = [F.lit(True)]
        if self.product is not None:
            terms.append(F.col("product") == self.product)
        if self.source is not None:
            terms.append(F.col("source") == self.source)
        if self.proc_codes:
            terms.append(F.col("proc_code").isin(*self.proc_codes))
        if self.ndcs:
            terms.append(F.col("ndc").isin(*self.ndcs))
        if self.ndc_missing:
            terms.append(F.col("ndc").isNull())
        if self.strengths:
            terms.append(F.col("strength").isin(*self.strengths))
        if self.generic_not is not None:
            terms.append(F.col("generic_name") != self.generic_not)
        return all_of(terms)


@dataclass(frozen=True)
class AccountRule:
    """A fixed segment for an account, optionally only below one parent at level 2 or 3."""

    label: str
    account_id: str
    level2_ids: tuple[str, ...] = ()
    level3_ids: tuple[str, ...] = ()

    def condition(self) -> Column:
        terms = [F.col("account_id") == self.account_id]
        if self.level2_ids:
            terms.append(F.col("level2_id").isin(*self.level2_ids))
        if self.level3_ids:
            terms.append(F.col("level3_id").isin(*self.level3_ids))
        return all_of(terms)


@dataclass(frozen=True)
class DosingRule:
    """How a product's fill is expected to last.

    A fill of ``quantity`` units lasts ``quantity / units_per_dose`` doses of
    ``interval_days`` each. With ``whole_doses`` the quantity must be a multiple of
    ``units_per_dose`` and other fills stay uncategorised; without it the dose count is
    rounded to the nearest whole number.
    """

    product: str
    strength: str
    units_per_dose: float
    whole_doses: bool = True
    interval_days: int = 14
    tolerance_days: int = 7

    def applies(self) -> Column:
        matches = (F.col("product") == self.product) & F.col("strength").ilike(f"%{self.strength}%")
        if self.whole_doses:
            matches = matches & (F.col("quantity") % F.lit(self.units_per_dose) == 0)
        return matches

    def expected_days(self) -> Column:
        doses = F.col("quantity") / F.lit(self.units_per_dose)
        if not self.whole_doses:
            doses = F.round(doses, 0)
        return doses * self.interval_days
