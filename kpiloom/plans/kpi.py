"""KPI specifications and the runner that turns them into one result table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (
    DateLike,
    all_of,
    any_of,
    day_of,
    month_of,
    month_start,
    require_columns,
    shift_months,
    slug,
    to_day,
    today_or,
)
from kpiloom.plans.registry import PATTERNS

PATTERN, SQL, RULES = "pattern", "sql", "rules"

#: Aggregates that take a FILTER clause, so that KPIs with different conditions can share a pass.
FUSED = ("sum", "count", "min", "max", "avg", "mean", "count_if", "approx_count_distinct", "stddev", "variance", "median")
Tables = str | Sequence[str] | Sequence[tuple[str, str]]
Span = tuple[DateLike, DateLike] | int | None


@dataclass(frozen=True)
class KpiSpec:
    """What one KPI is and how it is computed.

    ``grain`` names the key columns of a result row; ``window`` is a pair of days, a number of
    months back from the reference date, or open. ``value`` and ``period`` name the result's
    columns; without a period (None) there is a row per key, whose period is NULL, and no
    ``window``. The logic is one of three modes:

    ``pattern``
        a registered pattern id with ``params`` and ``tables``: for each argument the name of a
        table, or names of tables for an argument that takes a list of them, or pairs of label
        and name for one that takes labelled tables;
    ``sql``
        a query text that names the given tables in braces;
    ``rules``
        ``table``, ``date``, an aggregate ``measure``, ``filters`` that rows must meet and
        ``exclusions`` they must not. ``columns`` lists the columns that these may use. KPIs of
        this mode over one table and date whose measure is the text of a single aggregate are
        computed together, in one pass over the table.
    """

    name: str
    mode: str | None = None
    grain: tuple[str, ...] = ()
    window: Span = None
    definition: str = ""
    caveats: str = ""
    value: str = "value"
    period: str | None = "month"
    pattern: str | None = None
    tables: Mapping[str, Tables] = field(default_factory=dict)
    params: Mapping[str, Any] = field(default_factory=dict)
    sql: str | None = None
    table: str | None = None
    date: str | None = None
    measure: str | Column | None = None
    filters: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    @property
    def grain_text(self) -> str:
        return ", ".join(self.grain)

    def days(self, as_of: DateLike | None) -> tuple[DateLike | None, DateLike | None]:
        if self.window is None:
            return None, None
        if isinstance(self.window, int):
            end = today_or(as_of)
            return shift_months(month_start(end), -self.window), end
        return self.window


def pattern_ids(selected: Sequence[str], specs: Sequence[KpiSpec]) -> list[str]:
    """The selected pattern ids followed by those of the KPIs, each once, in order."""
    chosen = [s.pattern for s in specs if s.mode == PATTERN and s.pattern]
    return list(dict.fromkeys([*selected, *chosen]))


def _frames(given: Tables, tables: Mapping[str, DataFrame]) -> Any:
    if isinstance(given, str):
        return tables[given]
    return [tables[g] if isinstance(g, str) else (g[0], tables[g[1]]) for g in given]


def _by_pattern(spec: KpiSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    run = PATTERNS.get(spec.pattern or "")
    if run is None:
        raise ValueError(f"KPI {spec.name!r}: no pattern {spec.pattern!r}; known: {sorted(PATTERNS)}")
    frames = {argument: _frames(given, tables) for argument, given in spec.tables.items()}
    return run(**frames, **spec.params)


def _by_sql(spark: SparkSession, spec: KpiSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    if not spec.sql:
        raise ValueError(f"KPI {spec.name!r}: no query text given")
    used = {name: df for name, df in tables.items() if "{" + name + "}" in spec.sql}
    return spark.sql(spec.sql, **used)


def _by_rules(spec: KpiSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    if spec.table is None or spec.measure is None or spec.date is None:
        raise ValueError(f"KPI {spec.name!r}: rules need a table, a date and a measure")
    rows = tables[spec.table]
    require_columns(rows, spec.date, list(spec.grain), list(spec.columns))
    if spec.columns:
        used = dict.fromkeys([spec.date, *spec.grain, *spec.columns])
        rows = rows.select(*used).alias("rows")  # the alias hides the other columns
    measure = F.expr(spec.measure) if isinstance(spec.measure, str) else spec.measure
    period = [month_of(spec.date).alias(spec.period)] if spec.period else []
    return rows.filter(_counted(spec)).groupBy(*period, *spec.grain).agg(measure.alias(spec.value))


def _counted(spec: KpiSpec) -> Column:
    """Whether a row counts; an exclusion that is unknown for a row does not remove it."""
    excluded = any_of(F.coalesce(F.expr(e), F.lit(False)) for e in spec.exclusions)
    return F.coalesce(all_of(F.expr(c) for c in spec.filters), F.lit(False)) & ~excluded


# -- one pass for several KPIs -------------------------------------------------------------


def _single_aggregate(measure: Any) -> bool:
    """Whether the text is one call of an aggregate that takes a FILTER clause."""
    if not isinstance(measure, str):
        return False
    call = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", measure, re.DOTALL)
    if not call or call[1].lower() not in FUSED or re.search(r"['\"`]|--|/\*", call[2]):
        return False
    depth = 0
    for sign in call[2]:
        depth += {"(": 1, ")": -1}.get(sign, 0)
        if depth < 0:
            return False
    return True


def _groups(specs: Sequence[KpiSpec]) -> list[list[KpiSpec]]:
    """The specifications in sets that one pass can compute, in the order given."""
    groups: dict[Any, list[KpiSpec]] = {}
    for place, spec in enumerate(specs):
        alike = spec.mode == RULES and spec.period is not None and _single_aggregate(spec.measure)
        groups.setdefault((spec.table, spec.date) if alike else place, []).append(spec)
    return list(groups.values())


def _one_pass(specs: Sequence[KpiSpec], tables: Mapping[str, DataFrame], as_of: DateLike | None) -> DataFrame:
    """KPIs over one table as one aggregate: grouping sets for the grains, a filter for each measure.

    Rows that count for no KPI are dropped first. A KPI has a cell where a row counts for it.
    """
    table, date = specs[0].table, specs[0].date
    keys = list(dict.fromkeys(c for s in specs for c in s.grain))
    grains = list(dict.fromkeys(frozenset(s.grain) for s in specs))  # in whatever order a KPI names them
    conditions = {}
    for i, spec in enumerate(specs):
        first, last = spec.days(as_of)
        inside = F.lit(True) if first is None else month_of(date) >= F.lit(to_day(first))
        inside &= F.lit(True) if last is None else month_of(date) <= F.lit(to_day(last))
        conditions[f"__counts{i}"] = _counted(spec) & F.coalesce(inside, F.lit(False))
    named = {f"__grain{i}": F.col(c) for i, c in enumerate(keys)}  # a measure may use a key as well
    rows = tables[table].withColumns({**conditions, **named, "__month": month_of(date)})
    rows = rows.filter(any_of(map(F.col, conditions)))
    columns = [F.col(c) for c in ("__month", *named)]
    sets = [[F.col("__month"), *(F.col(n) for n, c in zip(named, keys) if c in grain)] for grain in grains]
    # the bit of a column is set where the set lacks it; the first column has the highest bit
    ids = [sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in grain) for grain in grains]
    aggregates = [F.grouping_id().alias("__set")]
    for i, spec in enumerate(specs):
        aggregates += [
            F.expr(f"{spec.measure} FILTER (WHERE __counts{i})").cast("double").alias(f"__value{i}"),
            F.count_if(f"__counts{i}").alias(f"__rows{i}"),
        ]
    cells = rows.groupingSets(sets, *columns).agg(*aggregates)
    lines = []
    for i, spec in enumerate(specs):
        here = F.col("__set") == ids[grains.index(frozenset(spec.grain))]
        line = _line(spec, [F.col(f"__grain{keys.index(c)}") for c in spec.grain], F.col("__month"), F.col(f"__value{i}"))
        lines.append(F.when(here & (F.col(f"__rows{i}") > 0), F.struct(*line)))
    return cells.select(F.inline(F.filter(F.array(*lines), lambda line: line.isNotNull())))


def _line(spec: KpiSpec, key: Sequence[Column], period: Column, value: Column) -> list[Column]:
    parts = [_key_part(k.cast("string")) for k in key]
    return [
        F.lit(spec.name).alias("kpi"),
        slug(F.lit(spec.name)).alias("kpi_id"),
        F.lit(spec.grain_text).alias("grain"),
        (F.concat_ws("|", *parts) if parts else F.lit("")).alias("grain_key"),
        period.alias("period"),
        value.cast("double").alias("value"),
    ]


def kpi_frame(
    spark: SparkSession,
    spec: KpiSpec,
    tables: Mapping[str, DataFrame],
    as_of: DateLike | None = None,
) -> DataFrame:
    """One KPI as ``kpi, kpi_id, grain, grain_key, period, value``.

    The grain key is the text of the key columns joined by ``|``; in a part, ``\\`` and ``|`` have
    a ``\\`` before them, and an unknown part is ``\\N``. So different keys have different texts.
    """
    if spec.mode == PATTERN:
        result = _by_pattern(spec, tables)
    elif spec.mode == SQL:
        result = _by_sql(spark, spec, tables)
    elif spec.mode == RULES:
        result = _by_rules(spec, tables)
    else:
        raise ValueError(f"KPI {spec.name!r}: logic not specified (mode {spec.mode!r})")
    require_columns(result, spec.period or (), spec.value, list(spec.grain))
    if spec.period is None and spec.window is not None:
        raise ValueError(f"KPI {spec.name!r}: a window needs a period")
    first, last = spec.days(as_of)
    if first is not None:
        result = result.filter(day_of(spec.period) >= F.lit(to_day(first)))
    if last is not None:
        result = result.filter(day_of(spec.period) <= F.lit(to_day(last)))
    period = F.lit(None).cast("date") if spec.period is None else day_of(spec.period)
    return result.select(*_line(spec, [F.col(c) for c in spec.grain], period, F.col(spec.value)))


def _key_part(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(escaped, F.lit("\\N"))


def run_kpis(
    spark: SparkSession,
    specs: Sequence[KpiSpec],
    tables: Mapping[str, DataFrame],
    as_of: DateLike | None = None,
) -> DataFrame:
    """All KPIs in one long table; those that can share a pass over their table do."""
    if not specs:
        raise ValueError("no KPI specifications given")
    repeated = {s.name for s in specs if sum(s.name == t.name for t in specs) > 1}
    if repeated:
        raise ValueError(f"KPI names must be unique, repeated: {sorted(repeated)}")
    frames = []
    for group in _groups(specs):
        # planned one by one in any case, which finds what is missing
        alone = [kpi_frame(spark, spec, tables, as_of) for spec in group]
        frames.append(alone[0] if len(group) == 1 else _one_pass(group, tables, as_of))
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def kpi_consistency(results: DataFrame) -> DataFrame:
    """Per KPI: grain, range of periods, how many periods and keys, and whether all KPIs agree.

    ``same_grain`` and ``same_window`` compare with the other KPIs of the table.
    """
    require_columns(results, "kpi", "grain", "grain_key", "period")
    per_period = results.groupBy("kpi", "grain", "period", "grain_key").agg(
        F.count(F.lit(1)).alias("rows")
    )
    per_kpi = per_period.groupBy("kpi", "grain").agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count_distinct("period").alias("periods"),
        F.count_distinct("grain_key").alias("grain_keys"),
        F.count_if(F.col("rows") > 1).alias("repeated_cells"),
    )
    everything = Window.partitionBy()  # one row per KPI

    def agree(column: str) -> Column:
        return F.min(column).over(everything).eqNullSafe(F.max(column).over(everything))

    return per_kpi.select(
        "*",
        F.when(agree("grain"), 1).otherwise(0).alias("same_grain"),
        F.when(agree("first_period") & agree("last_period"), 1).otherwise(0).alias("same_window"),
    )


def kpi_missing(results: DataFrame, specs: Sequence[KpiSpec]) -> DataFrame:
    """Periods and keys that a KPI lacks although another KPI of the same grain has them.

    A cell collects the names of the KPIs that have it: as many as there are specifications.
    """
    require_columns(results, "kpi", "grain", "grain_key", "period")
    if not specs:
        raise ValueError("no KPI specifications given")
    have = results.groupBy("grain", "period", "grain_key").agg(F.collect_set("kpi").alias("have"))
    by_grain: dict[str, list[str]] = {}
    for spec in specs:
        by_grain.setdefault(spec.grain_text, []).append(spec.name)
    expected = F.lit(None).cast("array<string>")
    for grain, kpis in by_grain.items():
        expected = F.when(F.col("grain") == grain, F.array(*map(F.lit, kpis))).otherwise(expected)
    lacking = F.explode(F.array_except(expected, "have"))
    return have.select(lacking.alias("kpi"), "grain", "period", "grain_key")
