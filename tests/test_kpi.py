from __future__ import annotations

import pytest
from conftest import rows

from kpiloom.plans import kpi


@pytest.fixture
def tables(frame):
    claims = frame(
        "entity_id long, service_date date, paid_amount double, region string, kind string",
        (1, "2024-01-05", 10, "N", "a"), (2, "2024-01-06", 20, "S", "a"), (1, "2024-02-05", 30, "N", None),
        (3, "2024-02-06", 40, None, "b"), (1, "2024-03-01", 50, "N", "a"),
    )
    return {"claims": claims}


TREND = kpi.KpiSpec(
    "Paid, total", mode="pattern", pattern="monthly_trend", tables={"claims": "claims"},
    params={"as_of": "2024-03-15"}, value="total_paid",
)
QUERY = kpi.KpiSpec(
    "Entities", mode="sql", grain=("region",), window=("2024-01-01", "2024-02-29"),
    sql="SELECT region, trunc(service_date, 'month') AS month, count(DISTINCT entity_id) AS value FROM {claims} GROUP BY 1, 2",
)
RULES = kpi.KpiSpec(
    "Described", mode="rules", grain=("region",), window=1, table="claims", date="service_date",
    measure="sum(paid_amount)", filters=("paid_amount > 10",), exclusions=("kind = 'b'",),
)


def test_every_mode_lands_in_one_table(spark, tables):
    result = kpi.run_kpis(spark, [TREND, QUERY, RULES], tables, as_of="2024-03-31")
    assert result.columns == ["kpi", "kpi_id", "grain", "grain_key", "period", "value"]
    assert rows(result, "kpi_id", "grain_key", "period", "value") == [
        ("described", "N", "2024-02-01", 30.0), ("described", "N", "2024-03-01", 50.0),
        ("entities", "N", "2024-01-01", 1.0), ("entities", "N", "2024-02-01", 1.0),
        ("entities", "S", "2024-01-01", 1.0), ("entities", "\\N", "2024-02-01", 1.0),
        ("paid-total", "", "2024-01-01", 30.0), ("paid-total", "", "2024-02-01", 70.0),
        ("paid-total", "", "2024-03-01", 50.0),
    ]


@pytest.mark.parametrize(
    "spec, message",
    [
        (kpi.KpiSpec("x"), "not specified"),
        (kpi.KpiSpec("x", mode="pattern", pattern="nope"), "no pattern 'nope'"),
        (kpi.KpiSpec("x", mode="sql"), "no query text"),
        (kpi.KpiSpec("x", mode="rules", table="claims"), "rules need"),
        (kpi.KpiSpec("x", mode="rules", grain=("town",), table="claims", date="service_date", measure="count(*)"), "town"),
    ],
)
def test_incomplete_specs_raise(spark, tables, spec, message):
    with pytest.raises(ValueError, match=message):
        kpi.run_kpis(spark, [spec], tables)


def test_names_must_be_unique(spark, tables):
    with pytest.raises(ValueError, match="unique"):
        kpi.run_kpis(spark, [TREND, TREND], tables)
    with pytest.raises(ValueError, match="no KPI"):
        kpi.run_kpis(spark, [], tables)


def test_pattern_ids_keep_order_without_repeats():
    again = kpi.KpiSpec("y", mode="pattern", pattern="yoy")
    assert kpi.pattern_ids(["yoy", "topn"], [TREND, QUERY, again]) == ["yoy", "topn", "monthly_trend"]


def test_consistency(spark, tables):
    results = kpi.run_kpis(spark, [QUERY, RULES], tables, as_of="2024-03-31")
    assert rows(kpi.kpi_consistency(results)) == [
        ("Described", "region", "2024-02-01", "2024-03-01", 2, 1, 0, 1, 0),
        ("Entities", "region", "2024-01-01", "2024-02-01", 2, 3, 0, 1, 0),
    ]
    mixed = kpi.run_kpis(spark, [TREND, QUERY], tables)
    assert {r.same_grain for r in kpi.kpi_consistency(mixed).collect()} == {0}


def test_missing_cells(spark, tables):
    specs = [TREND, QUERY, RULES]
    results = kpi.run_kpis(spark, specs, tables, as_of="2024-03-31")
    assert rows(kpi.kpi_missing(results, specs), "kpi", "grain_key", "period") == [
        ("Described", "N", "2024-01-01"), ("Described", "S", "2024-01-01"), ("Described", "\\N", "2024-02-01"),
        ("Entities", "N", "2024-03-01"),
    ]


def test_different_keys_have_different_texts(spark, frame):
    keys = [("x|y", "z"), ("x", "y|z"), ("", None), (None, ""), ("\\N", "\\"), (None, "\\|")]
    df = frame("a string, b string, n long", *[(*k, 1) for k in keys])
    spec = kpi.KpiSpec(
        "Keys", mode="sql", grain=("a", "b"), period=None, value="n", sql="SELECT * FROM {t}"
    )
    result = kpi.run_kpis(spark, [spec], {"t": df})
    assert len({r.grain_key for r in result.collect()}) == len(keys)
    assert kpi.kpi_consistency(result).first().repeated_cells == 0


def test_rules_use_only_their_columns(spark, tables):
    spec = kpi.KpiSpec(
        "Few", mode="rules", table="claims", date="service_date", measure="sum(paid_amount)",
        filters=("kind = 'a'",), columns=("paid_amount",),
    )
    with pytest.raises(Exception, match="kind"):
        kpi.run_kpis(spark, [spec], tables).collect()


def test_a_window_needs_a_period(spark, tables):
    spec = kpi.KpiSpec("x", mode="sql", sql="SELECT 1 AS value FROM {claims}", period=None, window=3)
    with pytest.raises(ValueError, match="needs a period"):
        kpi.run_kpis(spark, [spec], tables)


def described(name, measure, grain=(), **rules):
    return kpi.KpiSpec(name, mode="rules", table="claims", date="service_date", measure=measure, grain=grain, **rules)


FUSED = [
    described("Paid", "sum(paid_amount)"),
    described("Regions", "count(DISTINCT region)", ("region",), exclusions=("kind = 'b'",)),
    described("Both", "count(*)", ("kind", "region"), window=("2024-02-01", "2024-02-29")),
    described("Turned", "max(paid_amount)", ("region", "kind"), filters=("kind = 'a'",), columns=("paid_amount", "kind")),
    described("Named", "count(kind)", ("region",), window=("2024-02-01", None)),
    described("Nothing", "count(*)", filters=("paid_amount > 1000",)),
]


def test_kpis_in_one_pass_equal_each_alone(spark, tables, frame):
    undated = frame(
        "entity_id long, service_date date, paid_amount double, region string, kind string",
        (4, None, 5, "N", "a"), (4, None, None, None, None), (5, "2024-02-07", None, "S", None),
    )
    data = {"claims": tables["claims"].unionByName(undated)}
    assert [len(g) for g in kpi._groups(FUSED)] == [6]
    alone = [row for spec in FUSED for row in rows(kpi.kpi_frame(spark, spec, data))]
    together = kpi.run_kpis(spark, FUSED, data)
    assert rows(together) == sorted(alone, key=lambda r: [(v is None, str(v)) for v in r])
    assert len(alone) > 15 and together.dtypes == kpi.kpi_frame(spark, FUSED[0], data).dtypes
    assert rows(kpi.run_kpis(spark, FUSED, {"claims": data["claims"].limit(0)})) == []


def test_only_single_aggregates_share_a_pass(spark, tables):
    apart = ["sum(paid_amount) / count(*)", "round(sum(paid_amount))", "max(kind) = min('()')", "sum(paid_amount))", "count"]
    assert not any(map(kpi._single_aggregate, apart))
    assert all(map(kpi._single_aggregate, ["count(*)", " SUM( paid_amount * (1 + entity_id) )", "count(DISTINCT kind)"]))
    mixed = [RULES, described("Mean", "sum(paid_amount) / count(*)"), described("Rows", "count(*)"), QUERY]
    assert [[s.name for s in g] for g in kpi._groups(mixed)] == [["Described", "Rows"], ["Mean"], ["Entities"]]
    got = rows(kpi.run_kpis(spark, mixed, tables, as_of="2024-03-31"), "kpi", "period", "value")
    assert ("Mean", "2024-02-01", 35.0) in got and ("Rows", "2024-01-01", 2.0) in got
    hidden = described("Hidden", "sum(paid_amount)", columns=("kind",))
    with pytest.raises(Exception, match="paid_amount"):
        kpi.run_kpis(spark, [hidden, FUSED[0]], tables)
