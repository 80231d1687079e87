"""Independent SQL for every query of the catalog, in the DuckDB dialect.

The statements follow the definitions, not the Spark plans: windows over raw rows, joins and
distinct counts where the operators aggregate first.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

# fixed values: thresholds and labels of the definitions, written out so that they are compared
EVER_STAGES, NO_STAGE = (("Adopter", 4), ("User", 2), ("Trialist", 1)), "None"
INDEX_FILL, CONTINUOUS, SHORT_GAP, LAPSE = "Index Fill", "Continuous", "Short Gap", "Lapse / Restart"
SHORT_DAYS, LAPSE_DAYS = 45, 90
THREE_STAGES = {"exact": (("Trialist", 1), ("User", 2)), "at_least": ("Adopter", 3)}
TWO_STAGES = {"exact": (("Trialist", 1),), "at_least": ("Adopter", 5)}


def _case(branches: Iterable[tuple[str, str]], otherwise: str | None = None) -> str:
    """A CASE from (condition, label) pairs; NULL without a default."""
    whens = " ".join(f"WHEN {condition} THEN '{label}'" for condition, label in branches)
    return f"CASE {whens}" + (f" ELSE '{otherwise}'" if otherwise else "") + " END"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _pct(part: str, whole: str, digits: int = 1) -> str:
    """Percentage rounded half up on the decimal digits of the double, as Spark rounds."""
    value = f"CAST({part} AS DOUBLE) * 100.0 / nullif(CAST({whole} AS DOUBLE), 0.0)"
    return _round(value, digits)


def _ratio(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0.0)"


def _round(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


# -- bindings ----------------------------------------------------------------------------

CLAIMS = """claims AS (
  SELECT o_orderkey AS claim_id, o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS service_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS paid_amount, o_orderstatus AS order_status,
         o_orderpriority AS priority
  FROM orders)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey AS entity_id, c_name AS name, r_name AS region,
         CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

FILLS = """fills AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id,
         o_custkey AS entity_id, l_suppkey AS provider_id, p_brand AS product,
         p_name AS generic_name, p_type AS product_class, CAST(l_shipdate AS DATE) AS service_date,
         CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS new_start, l_quantity AS quantity,
         CAST(l_quantity * 7 + ((l_linenumber % 5) - 2) * 7 AS INTEGER) AS days_supply,
         CASE WHEN p_size % 2 = 0 THEN '40 UNITS' ELSE '25 UNITS' END AS strength,
         CASE WHEN l_returnflag = 'A' THEN 'MX' ELSE 'RX' END AS source, p_type AS proc_code,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey AS VARCHAR) END AS ndc,
         CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE 1920 + o_custkey % 100 END AS birth_year,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey)"""

TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

CALLS = """calls AS (
  SELECT user_id AS entity_id, event_id % 997 AS provider_id, event_type AS activity_type,
         DATE '1995-01-01' + CAST(event_id * 37 % 2400 AS INTEGER) AS activity_date,
         'Brand#' || CAST(event_id % 25 + 1 AS VARCHAR) AS product,
         CASE WHEN event_id % 3 = 0 THEN 'DESK' ELSE 'FIELD' END AS department,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'VISIT'
              WHEN event_id % 4 = 1 THEN 'PARCEL' WHEN event_id % 4 = 2 THEN 'FAIR'
              ELSE 'RECALL' END AS classification,
         CASE WHEN event_id % 5 = 0 THEN 'SUPPLY' ELSE 'OUTBOUND' END AS purpose,
         CASE WHEN event_id % 7 = 0 THEN 'CREW' ELSE 'BUYER' END AS contact_type
  FROM events)"""


def _roster(name: str, classes: tuple[str, str], first: str, last: str) -> str:
    return f"""{name} AS (
  SELECT entity_id, service_date AS diagnosis_date FROM fills
  WHERE product_class IN {classes} AND service_date BETWEEN DATE '{first}' AND DATE '{last}')"""


A, B = ("PROMO", "ECONOMY"), ("STANDARD", "LARGE")

ORACLE_SQL: dict[str, str] = {}

# -- patterns ----------------------------------------------------------------------------

ORACLE_SQL["dedup_latest"] = f"""WITH {CLAIMS}
SELECT claim_id, entity_id, service_date, CAST(paid_amount AS DOUBLE) AS paid_amount,
       order_status, priority
FROM claims
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY service_date DESC, claim_id DESC) = 1"""

ORACLE_SQL["date_spine_fill"] = f"""WITH {CLAIMS},
spine AS (SELECT CAST(unnest(generate_series(DATE '1994-11-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS month),
metric AS (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month,
                  count(DISTINCT entity_id) AS metric_value FROM claims GROUP BY 1)
SELECT s.month, coalesce(m.metric_value, 0) AS metric_value
FROM spine s LEFT JOIN metric m ON s.month = m.month"""

ORACLE_SQL["date_spine_fill_by_key"] = f"""WITH {FILLS},
spine AS (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS month),
ids AS (SELECT DISTINCT provider_id FROM fills),
metric AS (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, provider_id,
                  count(DISTINCT l_orderkey) AS metric_value FROM fills GROUP BY 1, 2)
SELECT s.month, i.provider_id, coalesce(m.metric_value, 0) AS metric_value
FROM spine s CROSS JOIN ids i
LEFT JOIN metric m ON s.month = m.month AND i.provider_id = m.provider_id"""

_MONTHLY_VALUE = f"""{CLAIMS},
monthly AS (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, entity_id,
                   sum(paid_amount) AS monthly_value FROM claims GROUP BY 1, 2)"""


def _rolling(source: str) -> str:
    window = "(PARTITION BY entity_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    total = f"sum(monthly_value) OVER {window}"
    return f"""SELECT month, entity_id, CAST(monthly_value AS DOUBLE) AS monthly_value,
       CAST({total} AS DOUBLE) AS rolling_3m_sum,
       {_ratio(total, f"count(monthly_value) OVER {window}")} AS rolling_3m_avg
FROM {source}"""


ORACLE_SQL["rolling_3m"] = f"WITH {_MONTHLY_VALUE}\n{_rolling('monthly')}"

ORACLE_SQL["rolling_3m_gap_filled"] = f"""WITH {_MONTHLY_VALUE},
span AS (SELECT entity_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS m
         FROM monthly GROUP BY entity_id),
filled AS (SELECT CAST(s.m AS DATE) AS month, s.entity_id, coalesce(v.monthly_value, 0) AS monthly_value
           FROM span s LEFT JOIN monthly v ON v.month = CAST(s.m AS DATE) AND v.entity_id = s.entity_id)
{_rolling('filled')}"""


def _yoy(this_year: str, last_year: str, days: str = "DATE '1999-01-01' AND DATE '2001-08-01'") -> str:
    return f"""WITH {CLAIMS}, counts AS (
  SELECT entity_id, CAST(sum(CASE WHEN {this_year} THEN 1 ELSE 0 END) AS BIGINT) AS cy_count,
         CAST(sum(CASE WHEN {last_year} THEN 1 ELSE 0 END) AS BIGINT) AS py_count
  FROM claims WHERE service_date BETWEEN {days} GROUP BY 1)
SELECT entity_id, cy_count, py_count, cy_count - py_count AS yoy_abs_change,
       {_pct("cy_count - py_count", "py_count")} AS yoy_pct_change
FROM counts"""


ORACLE_SQL["yoy"] = _yoy("year(service_date) = 2001", "year(service_date) = 2000")
ORACLE_SQL["yoy_ytd"] = _yoy(
    "service_date BETWEEN DATE '2001-01-01' AND DATE '2001-08-01'",
    "service_date BETWEEN DATE '2000-01-01' AND DATE '2000-08-01'",
)

ORACLE_SQL["yoy_past"] = _yoy(
    "year(service_date) = 1999",
    "year(service_date) = 1998",
    "DATE '1997-01-01' AND DATE '1999-03-17'",
)

_MONTHS = """(year(e.service_date) - year(a.first_day)) * 12
              + month(e.service_date) - month(a.first_day)"""
_BOTH_LAST = "(e.service_date = last_day(e.service_date) AND a.first_day = last_day(a.first_day))"


def _cohort(offset: str) -> str:
    return f"""WITH {CLAIMS},
anchor AS (SELECT entity_id, min(service_date) AS first_day FROM claims GROUP BY 1)
SELECT CAST(date_trunc('month', a.first_day) AS DATE) AS cohort_month,
       {offset} AS months_since_start, count(DISTINCT e.entity_id) AS active_entities
FROM claims e JOIN anchor a ON e.entity_id = a.entity_id
WHERE e.service_date >= a.first_day GROUP BY 1, 2"""


ORACLE_SQL["cohort_retention"] = _cohort(f"CAST({_MONTHS} AS INTEGER)")
ORACLE_SQL["cohort_whole_months"] = _cohort(
    f"""CAST({_MONTHS} - CASE WHEN day(e.service_date) < day(a.first_day) AND NOT {_BOTH_LAST}
        THEN 1 ELSE 0 END AS INTEGER)"""
)
ORACLE_SQL["cohort_exact_months"] = _cohort(
    f"""CASE WHEN day(e.service_date) = day(a.first_day) OR {_BOTH_LAST} THEN CAST({_MONTHS} AS DOUBLE)
        ELSE round({_MONTHS} + (day(e.service_date) - day(a.first_day)) / CAST(31 AS DOUBLE), 8) END"""
)

_FUNNEL = f"""{CLAIMS},
flags AS (
  SELECT c.c_custkey AS entity_id,
         CASE WHEN EXISTS (SELECT 1 FROM claims x WHERE x.entity_id = c.c_custkey
                           AND year(x.service_date) = 1999) THEN 1 ELSE 0 END AS step_2_seen,
         CASE WHEN EXISTS (SELECT 1 FROM claims x WHERE x.entity_id = c.c_custkey
                           AND year(x.service_date) = 2000 AND x.paid_amount > 200000)
              THEN 1 ELSE 0 END AS step_3_large
  FROM customer c)"""

ORACLE_SQL["funnel_flags"] = f"WITH {_FUNNEL} SELECT * FROM flags"
ORACLE_SQL["funnel_steps"] = f"""WITH {_FUNNEL}, counts AS (
  SELECT count(*) AS universe, CAST(sum(step_2_seen) AS BIGINT) AS step_2_seen,
         CAST(sum(step_3_large) AS BIGINT) AS step_3_large FROM flags)
SELECT *, {_pct("step_2_seen", "universe")} AS universe_to_step_2_seen_pct,
       {_pct("step_3_large", "step_2_seen")} AS step_2_seen_to_step_3_large_pct FROM counts"""

_TIERS = [
    ("paid_amount > 300000 AND order_status = 'F'", "Segment A"),
    ("paid_amount > 200000", "Segment B"),
    ("order_status = 'P'", "Segment C"),
]
_TIER_FLAGS = ", ".join(f"{_flag(cond)} AS flag_tier_{i}" for i, (cond, _) in enumerate(_TIERS, 1))

_SEGMENTED = f"""{CLAIMS},
segmented AS (
  SELECT claim_id, entity_id, service_date, CAST(paid_amount AS DOUBLE) AS paid_amount, order_status,
         priority, {_case(_TIERS, "Other")} AS segment, {_TIER_FLAGS}
  FROM claims)"""

ORACLE_SQL["waterfall_segment"] = f"WITH {_SEGMENTED} SELECT * FROM segmented"

_STAGES = [(f"distinct_event_days >= {n}", label) for label, n in EVER_STAGES]
_STAGE_FLAGS = ", ".join(f"{_flag(cond)} AS is_{label.lower()}" for cond, label in _STAGES)

ORACLE_SQL["ever_flag"] = f"""WITH {CLAIMS}, counts AS (
  SELECT entity_id, priority, min(service_date) AS first_event_date,
         count(DISTINCT service_date) AS distinct_event_days, count(*) AS total_events
  FROM claims GROUP BY 1, 2)
SELECT *, {_case(_STAGES, NO_STAGE)} AS classification, {_STAGE_FLAGS} FROM counts"""

_STATUS = _case(
    [
        ("fill_number = 1", INDEX_FILL),
        (f"days_since_prior_fill <= {SHORT_DAYS}", CONTINUOUS),
        (f"days_since_prior_fill <= {LAPSE_DAYS}", SHORT_GAP),
    ],
    LAPSE,
)

ORACLE_SQL["fill_gap"] = f"""WITH {FILLS}, gaps AS (
  SELECT entity_id, {TIES}, service_date AS fill_date,
         lag(service_date) OVER w AS prior_fill_date,
         CAST(datediff('day', lag(service_date) OVER w, service_date) AS INTEGER) AS days_since_prior_fill,
         row_number() OVER w AS fill_number
  FROM fills WINDOW w AS (PARTITION BY entity_id ORDER BY service_date, {TIES}))
SELECT *, {_STATUS} AS persistence_status FROM gaps"""
ORACLE_SQL["fill_gap_hot_keys"] = ORACLE_SQL["fill_gap"].replace(
    "FROM fills WINDOW",
    "FROM (SELECT * REPLACE (CASE WHEN entity_id % 5 = 0 THEN 0 WHEN entity_id % 5 <> 1 THEN entity_id END"
    " AS entity_id) FROM fills) WINDOW",
)

_ONE_DAY = """(SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE entity_id END AS entity_id,
                        CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN DATE '1997-01-01'
                             ELSE service_date END AS service_date) FROM fills)"""
ORACLE_SQL["fill_gap_one_day"] = (
    ORACLE_SQL["fill_gap"]
    .replace("FROM fills WINDOW", f"FROM {_ONE_DAY} WINDOW")
    .replace("ORDER BY service_date,", "ORDER BY service_date NULLS FIRST,")
)

ORACLE_SQL["fill_gap_by_day"] = f"""WITH {FILLS}, days AS (
  SELECT entity_id, service_date AS fill_date, count(*) AS fills_on_day FROM fills GROUP BY 1, 2),
gaps AS (
  SELECT *, lag(fill_date) OVER w AS prior_fill_date,
         CAST(datediff('day', lag(fill_date) OVER w, fill_date) AS INTEGER) AS days_since_prior_fill,
         row_number() OVER w AS fill_number
  FROM days WINDOW w AS (PARTITION BY entity_id ORDER BY fill_date))
SELECT *, {_STATUS} AS persistence_status FROM gaps"""

ORACLE_SQL["truncation_audit"] = f"""WITH {CLAIMS}, monthly AS (
  SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, count(*) AS row_count
  FROM claims GROUP BY 1),
shares AS (
  SELECT month, row_count, {_ratio("row_count", "max(row_count) OVER ()")} AS pct_of_peak_month,
         {_ratio("row_count", "lag(row_count) OVER (ORDER BY month)")} AS pct_of_prior_month
  FROM monthly)
SELECT *, CASE WHEN month = (SELECT max(month) FROM monthly) AND pct_of_prior_month < 0.8
               THEN 1 ELSE 0 END AS is_truncated
FROM shares ORDER BY month DESC LIMIT 6"""

ORACLE_SQL["truncation_audit_files"] = ORACLE_SQL["truncation_audit"]

ORACLE_SQL["actuals_vs_goals"] = f"""WITH {FILLS},
actuals AS (
  SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, CAST(provider_id AS VARCHAR) AS provider_id,
         count(DISTINCT l_orderkey) AS actual_value FROM fills GROUP BY 1, 2),
goals AS (
  SELECT CAST(date_trunc('month', service_date) + INTERVAL 12 MONTH AS DATE) AS month,
         CAST(provider_id AS VARCHAR) AS provider_id,
         CAST(floor(CAST(1.1 AS DOUBLE) * count(*)) AS BIGINT) AS goal_value FROM fills GROUP BY 1, 2)
SELECT coalesce(a.month, g.month) AS month, coalesce(a.provider_id, g.provider_id) AS provider_id,
       a.actual_value, g.goal_value, coalesce(a.actual_value, 0) AS actual_filled,
       coalesce(g.goal_value, 0) AS goal_filled,
       {_pct("coalesce(a.actual_value, 0)", "coalesce(g.goal_value, 0)")} AS pct_to_goal
FROM actuals a FULL OUTER JOIN goals g ON a.month = g.month AND a.provider_id = g.provider_id"""

ORACLE_SQL["actuals_vs_goals_money"] = f"""WITH {CLAIMS},
actuals AS (SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, order_status,
                   sum(paid_amount) AS actual_value FROM claims GROUP BY 1, 2),
goals AS (SELECT CAST(month + INTERVAL 12 MONTH AS DATE) AS month, order_status,
                 actual_value * 0.75 AS goal_value FROM actuals)
SELECT coalesce(a.month, g.month) AS month, coalesce(a.order_status, g.order_status) AS order_status,
       CAST(a.actual_value AS DOUBLE) AS actual_value, CAST(g.goal_value AS DOUBLE) AS goal_value,
       CAST(coalesce(a.actual_value, 0) AS DOUBLE) AS actual_filled,
       CAST(coalesce(g.goal_value, 0) AS DOUBLE) AS goal_filled,
       {_pct("coalesce(a.actual_value, 0)", "coalesce(g.goal_value, 0)")} AS pct_to_goal
FROM actuals a FULL OUTER JOIN goals g ON a.month = g.month AND a.order_status = g.order_status"""

_RANKED = f"""WITH {CLAIMS}, ranked AS (
  SELECT claim_id, CAST(round(paid_amount, -3) AS DOUBLE) AS paid, order_status FROM claims)
SELECT claim_id, paid, order_status,
       {{kind}}(row_number() OVER (ORDER BY paid DESC, claim_id DESC)) AS overall_rank,
       {{kind}}(dense_rank() OVER (ORDER BY paid DESC)) AS overall_rank_dense,
       {{kind}}(row_number() OVER (PARTITION BY order_status ORDER BY paid DESC, claim_id DESC))
         AS rank_within_segment
FROM ranked"""

ORACLE_SQL["topn_full"] = _RANKED.replace("{kind}(", "(")
ORACLE_SQL["topn"] = (
    "SELECT claim_id, paid, order_status, CAST(overall_rank AS INTEGER) AS overall_rank, "
    "CAST(overall_rank_dense AS INTEGER) AS overall_rank_dense, "
    "CAST(rank_within_segment AS INTEGER) AS rank_within_segment FROM ("
    + ORACLE_SQL["topn_full"]
    + ") WHERE overall_rank <= 100"
)

# -- worked queries ----------------------------------------------------------------------

def _entity_summary(since: str, until: str) -> str:
    return f"""WITH {FILLS}, {CLAIMS}, {CUSTOMERS}, {CALLS},
{_roster("roster", A, "1998-01-01", "2001-06-30")},
recent AS (SELECT entity_id, max(diagnosis_date) AS diagnosis_date FROM roster
           WHERE diagnosis_date BETWEEN DATE '{since}' AND DATE '{until}' GROUP BY 1),
paid AS (SELECT entity_id, sum(paid_amount) AS total_paid, count(DISTINCT claim_id) AS claim_count
         FROM claims WHERE service_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1),
contacts AS (SELECT entity_id, count(*) AS total_calls, max(activity_date) AS last_call_date
             FROM calls WHERE activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1)
SELECT c.entity_id, c.name, c.region, r.diagnosis_date,
       CAST(coalesce(p.total_paid, 0) AS DOUBLE) AS total_paid,
       coalesce(p.claim_count, 0) AS claim_count, coalesce(k.total_calls, 0) AS total_calls,
       k.last_call_date,
       CASE WHEN k.entity_id IS NOT NULL THEN 'Contacted' ELSE 'Not Contacted' END AS outreach_status
FROM recent r JOIN customers c ON r.entity_id = c.entity_id
LEFT JOIN paid p ON r.entity_id = p.entity_id LEFT JOIN contacts k ON r.entity_id = k.entity_id"""


ORACLE_SQL["entity_summary"] = _entity_summary("1999-08-01", "2001-08-01")
ORACLE_SQL["entity_summary_past"] = _entity_summary("1997-03-17", "1999-03-17")

ORACLE_SQL["comorbidity"] = f"""WITH {FILLS}, {CUSTOMERS},
{_roster("roster_a", A, "2001-01-01", "2001-03-31")},
{_roster("roster_b", B, "2001-02-01", "2001-04-30")},
flags AS (
  SELECT entity_id, name, region,
         {_flag("entity_id IN (SELECT entity_id FROM roster_a)")} AS has_a,
         {_flag("entity_id IN (SELECT entity_id FROM roster_b)")} AS has_b
  FROM customers WHERE status = 'active')
SELECT *, {_case([("has_a + has_b = 2", "Comorbid"), ("has_a = 1", "A Only"), ("has_b = 1", "B Only")],
                 "Neither")} AS condition_segment
FROM flags"""

def _trend(first: str, last: str, filled: bool = False) -> str:
    months = f"""(SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 MONTH)) AS DATE) AS month)"""
    source = (
        f"(SELECT s.month, coalesce(m.total_paid, 0) AS total_paid, coalesce(unique_entities, 0) AS unique_entities"
        f" FROM {months} s LEFT JOIN monthly m ON m.month = s.month)"
    )
    return f"""WITH {CLAIMS}, monthly AS (
  SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, sum(paid_amount) AS total_paid,
         count(DISTINCT entity_id) AS unique_entities
  FROM claims WHERE service_date BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY 1),
lagged AS (SELECT *, lag(total_paid) OVER (ORDER BY month) AS prior
           FROM {source if filled else "monthly"})
SELECT month, CAST(total_paid AS DOUBLE) AS total_paid, unique_entities,
       CAST(prior AS DOUBLE) AS prior_month_paid,
       {_pct("total_paid - prior", "prior")} AS mom_pct_change
FROM lagged"""


ORACLE_SQL["monthly_trend_mom"] = _trend("2000-08-01", "2001-08-01")
ORACLE_SQL["monthly_trend_past"] = _trend("1998-03-01", "1999-03-17")
ORACLE_SQL["monthly_trend_past_filled"] = _trend("1998-03-01", "1999-03-17", filled=True)

ORACLE_SQL["monthly_trend_by_region"] = f"""WITH {CLAIMS}, {CUSTOMERS},
placed AS (SELECT c.*, k.region FROM claims c LEFT JOIN customers k ON c.entity_id = k.entity_id),
monthly AS (
  SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, region,
         sum(paid_amount) AS total_paid, count(DISTINCT entity_id) AS unique_entities
  FROM placed WHERE service_date >= DATE '2000-02-01' GROUP BY 1, 2),
spine AS (SELECT CAST(unnest(generate_series(DATE '2000-02-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS month),
cells AS (SELECT month, region FROM spine CROSS JOIN (SELECT DISTINCT region FROM monthly)),
filled AS (
  SELECT c.month, c.region, coalesce(m.total_paid, 0) AS total_paid,
         coalesce(m.unique_entities, 0) AS unique_entities
  FROM cells c LEFT JOIN monthly m ON m.month = c.month AND m.region = c.region),
lagged AS (SELECT *, lag(total_paid) OVER (PARTITION BY region ORDER BY month) AS prior FROM filled)
SELECT month, region, CAST(total_paid AS DOUBLE) AS total_paid, unique_entities,
       CAST(prior AS DOUBLE) AS prior_month_paid,
       {_pct("total_paid - prior", "prior")} AS mom_pct_change
FROM lagged"""

_COST = f"""WITH {FILLS}, {CLAIMS}, {CUSTOMERS},
{_roster("roster", A, "2001-01-01", "2001-06-30")},
members AS (
  SELECT f.entity_id, sum(f.paid_amount) AS total_paid, count(DISTINCT f.claim_id) AS claim_count
  FROM claims f JOIN (SELECT {{kind}} entity_id FROM roster) r ON f.entity_id = r.entity_id
  WHERE f.service_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1),
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY total_paid DESC, m.entity_id) AS INTEGER) AS cost_rank,
         m.entity_id, c.name, c.region, CAST(total_paid AS DOUBLE) AS total_paid, claim_count
  FROM members m LEFT JOIN customers c ON m.entity_id = c.entity_id)
SELECT * FROM ranked WHERE cost_rank <= 10"""

ORACLE_SQL["top_cost"] = _COST.replace("{kind}", "DISTINCT")
ORACLE_SQL["top_cost_per_roster_row"] = _COST.replace("{kind}", "")


def _call_funnel(order: str) -> str:
    return f"""WITH {FILLS}, {CLAIMS}, {CALLS},
{_roster("roster", A, "2000-01-01", "2001-06-30")},
called AS (SELECT entity_id, min(activity_date) AS first_call FROM calls
           WHERE activity_type = 'click' AND activity_date >= DATE '2000-06-01' GROUP BY 1),
claimed AS (SELECT DISTINCT f.entity_id FROM claims f JOIN called c ON f.entity_id = c.entity_id
            WHERE f.service_date >= DATE '2000-06-01' {order}),
steps AS (
  SELECT count(DISTINCT i.entity_id) AS step_1_identified, count(DISTINCT c.entity_id) AS step_2_called,
         count(DISTINCT x.entity_id) AS step_3_claimed
  FROM (SELECT DISTINCT entity_id FROM roster) i LEFT JOIN called c ON i.entity_id = c.entity_id
  LEFT JOIN claimed x ON i.entity_id = x.entity_id)
SELECT *, {_pct("step_2_called", "step_1_identified")} AS call_rate_pct,
       {_pct("step_3_claimed", "step_2_called")} AS post_call_claim_rate_pct FROM steps"""


ORACLE_SQL["call_funnel"] = _call_funnel("")
ORACLE_SQL["call_funnel_ordered"] = _call_funnel("AND f.service_date >= c.first_call")

ORACLE_SQL["rolling_3m_range"] = f"""WITH {CLAIMS}, days AS (
  SELECT service_date AS as_of_date, sum(paid_amount) AS daily FROM claims GROUP BY 1)
SELECT as_of_date, CAST(daily AS DOUBLE) AS daily_value,
       CAST((SELECT sum(x.daily) FROM days x
             WHERE x.as_of_date BETWEEN CAST(d.as_of_date - INTERVAL 3 MONTH AS DATE) AND d.as_of_date)
            AS DOUBLE) AS rolling_3m
FROM days d"""

ORACLE_SQL["fixed_lod_avg"] = f"""WITH {CLAIMS}, {CUSTOMERS},
placed AS (SELECT c.*, k.region FROM claims c LEFT JOIN customers k ON c.entity_id = k.entity_id),
fixed AS (SELECT region, {_ratio("sum(paid_amount)", "count(paid_amount)")} AS fixed_avg,
                 {_ratio("sum(paid_amount)", "count(DISTINCT entity_id)")} AS fixed_avg_per_entity
          FROM placed GROUP BY region),
shown AS (SELECT region, order_status, count(*) AS view_rows,
                 {_ratio("sum(paid_amount)", "count(paid_amount)")} AS view_avg
          FROM placed WHERE year(service_date) = 2000 GROUP BY 1, 2)
SELECT s.*, f.fixed_avg, f.fixed_avg_per_entity FROM shown s JOIN fixed f ON s.region = f.region"""


def _rolling_6m(read_from: str) -> str:
    return f"""WITH {FILLS}, monthly AS (
  SELECT provider_id, product, CAST(date_trunc('month', service_date) AS DATE) AS month,
         CAST(sum(new_start) AS BIGINT) AS new_starts
  FROM fills
  WHERE product = 'Brand#7'
    AND date_trunc('month', service_date) BETWEEN DATE '{read_from}' AND DATE '2001-03-31'
  GROUP BY 1, 2, 3),
rolled AS (
  SELECT *, CAST(sum(new_starts) OVER (PARTITION BY provider_id, product ORDER BY month
                 ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_6m FROM monthly)
SELECT * FROM rolled WHERE month >= DATE '2000-01-01'"""


ORACLE_SQL["rolling_6m"] = _rolling_6m("2000-01-01")
ORACLE_SQL["rolling_6m_warmup"] = _rolling_6m("1999-08-01")

_IN_PERIOD = "date_trunc('month', service_date) BETWEEN DATE '{}' AND DATE '{}'"
_PRE = _IN_PERIOD.format("1999-11-01", "2000-01-31")
_POST = _IN_PERIOD.format("2000-02-01", "2000-04-30")

ORACLE_SQL["period_growth_entity"] = f"""WITH {FILLS},
pre AS (SELECT provider_id, CAST(sum(new_start) AS BIGINT) AS n FROM fills
        WHERE product = 'Brand#7' AND {_PRE} GROUP BY 1),
post AS (SELECT provider_id, CAST(sum(new_start) AS BIGINT) AS n FROM fills
         WHERE product = 'Brand#7' AND {_POST} GROUP BY 1),
merged AS (
  SELECT coalesce(post.provider_id, pre.provider_id) AS provider_id, coalesce(pre.n, 0) AS pre,
         coalesce(post.n, 0) AS post
  FROM pre FULL OUTER JOIN post ON pre.provider_id = post.provider_id)
SELECT *, post - pre AS abs_change, {_pct("post - pre", "pre")} AS pct_change FROM merged"""

ORACLE_SQL["period_growth_market"] = f"""WITH {FILLS}, totals AS (
  SELECT CAST(sum(CASE WHEN {_PRE} THEN new_start ELSE 0 END) AS BIGINT) AS pre,
         CAST(sum(CASE WHEN {_POST} THEN new_start ELSE 0 END) AS BIGINT) AS post
  FROM fills WHERE product = 'Brand#7' AND ({_PRE} OR {_POST}))
SELECT *, post - pre AS abs_change, {_pct("post - pre", "pre")} AS pct_change FROM totals"""

_ACCOUNT_NAME = """n_name || CASE WHEN n_nationkey % 6 = 0 THEN ' University'
            WHEN n_nationkey % 6 = 1 THEN ' Research Park' ELSE '' END"""

_ACCOUNTS = f"""provider_account AS (
  SELECT c_custkey AS provider_id, CAST(c_nationkey AS VARCHAR) AS account_id,
         '  ' || {_ACCOUNT_NAME} || ' ' AS account_name, c_name AS customer_ref
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
training AS (
  SELECT c_custkey AS provider_id,
         CASE WHEN c_custkey % 9 <> 0
              THEN DATE '1999-01-01' + CAST(c_custkey * 13 % 1200 AS INTEGER) END AS training_to
  FROM customer),
counts AS (
  SELECT account_id,
         count(CASE WHEN training_to > DATE '2001-09-30' THEN 1 END) AS trainees,
         count(CASE WHEN training_to <= DATE '2001-09-30' THEN 1 END) AS non_trainees,
         count(p.provider_id) AS providers
  FROM provider_account p LEFT JOIN training t ON p.provider_id = t.provider_id GROUP BY 1),
shares AS (
  SELECT *, trainees + non_trainees AS known,
         CASE WHEN trainees + non_trainees > 0 THEN
           CAST(round(CAST(trainees * 100 / CAST(trainees + non_trainees AS DOUBLE) AS DECIMAL(30,10)), 4)
                * 0.01 AS DOUBLE) END AS trainee_share
  FROM counts)"""

ORACLE_SQL["trainee_ratio"] = f"WITH {_ACCOUNTS} SELECT * FROM shares"

_ACCOUNT_SEGMENT = f"""{_ACCOUNTS},
flagged AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS account_id, label,
         CASE WHEN n_nationkey % 4 <> 3 THEN 1 ELSE 0 END AS flag_a,
         CASE WHEN n_nationkey % 15 = 7 THEN 1 ELSE 0 END AS flag_b
  FROM nation, (VALUES ('Community'), ('Academic')) AS l(label)
  WHERE n_nationkey % 5 = 2 AND (label = 'Community' OR n_nationkey % 10 = 2)),
forced AS (SELECT account_id, min(label) AS label FROM flagged
           WHERE flag_a = 1 OR flag_b = 1 GROUP BY 1),
networks AS (
  SELECT DISTINCT upper(trim({_ACCOUNT_NAME})) AS network_name FROM nation WHERE n_nationkey % 4 = 0),
segmented AS (
  SELECT p.provider_id, p.customer_ref, p.account_id, p.account_name,
         CASE WHEN f.label IS NOT NULL THEN f.label
              WHEN p.account_id = '3' AND p.provider_id % 7 IN (1, 4) THEN 'Community'
              WHEN p.account_id = '3' AND p.provider_id % 3 = 2 THEN 'Academic'
              WHEN (s.known >= 30 AND s.trainee_share >= 0.15) OR p.account_name ILIKE '%university%'
                   OR p.account_name ILIKE '%research%' THEN 'Academic'
              WHEN n.network_name IS NOT NULL THEN 'IDN' ELSE 'Other' END AS account_segment_granular
  FROM provider_account p LEFT JOIN forced f ON p.account_id = f.account_id
  LEFT JOIN shares s ON p.account_id = s.account_id
  LEFT JOIN networks n ON upper(trim(p.account_name)) = n.network_name)"""

ORACLE_SQL["account_segment"] = f"WITH {_ACCOUNT_SEGMENT} SELECT * FROM segmented"
ORACLE_SQL["account_rollup"] = f"""WITH {_ACCOUNT_SEGMENT}
SELECT *, CASE WHEN account_segment_granular = 'Community' THEN 'Community'
               ELSE 'Non-Community' END AS account_segment FROM segmented"""

_IS_BASE = " OR ".join(f"contains(regimen, '{word}')" for word in ("PROMO", "ECONOMY", "STANDARD"))
_REGIMEN = _case(
    [
        ("contains(regimen, 'LARGE')", "Focal"),
        (f"contains(regimen, 'Brand#1') AND ({_IS_BASE})", "Base and partner"),
        ("contains(regimen, 'Brand#1')", "Partner"),
        (f"({_IS_BASE})", "Base"),
    ],
    "Other",
)
# coalesce(line_f, line) >= line: no focal line yet, or this one, or a later one
_BUCKET = _case(
    [
        ("line > greatest(line_a, line_b) AND line_a + line_b > 0 AND coalesce(line_f, line) >= line", "After both"),
        ("line > line_a AND coalesce(line_f, line) >= line", "After one"),
        ("line = 1", "First line"),
        ("line_a IS NULL OR (line BETWEEN 2 AND line_a - 1)", "Naive"),
    ]
)

_LINES = f"""{FILLS},
first_fills AS (
  SELECT entity_id AS patient_id, provider_id, product_class,
         product_class || ' ' || product AS regimen, service_date AS start_date
  FROM fills
  QUALIFY row_number() OVER (PARTITION BY entity_id, product_class ORDER BY service_date, {TIES}) = 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY start_date, product_class) AS line
  FROM first_fills),
lines AS (
  SELECT *, 1 AS line_initiation,
         min(CASE WHEN product_class = 'PROMO' THEN line END) OVER (PARTITION BY patient_id) AS line_a,
         min(CASE WHEN product_class = 'ECONOMY' THEN line END) OVER (PARTITION BY patient_id) AS line_b,
         min(CASE WHEN product_class = 'LARGE' THEN line END) OVER (PARTITION BY patient_id) AS line_f
  FROM numbered),
tagged AS (
  SELECT DISTINCT patient_id, strftime(start_date, '%Y-%m') AS month, line, provider_id, regimen,
         CASE WHEN date_trunc('month', start_date) >= DATE '1996-12-01' THEN 1 ELSE 0 END AS eligible,
         {_REGIMEN} AS regimen_class,
         {_BUCKET} AS bucket,
         line_initiation, line_a, line_b, line_f
  FROM lines WHERE line_initiation = 1),
classified AS (
  SELECT patient_id, month, CAST(line AS INTEGER) AS line, provider_id, eligible, regimen_class, bucket,
         CAST(sum(line_initiation) AS BIGINT) AS patients
  FROM tagged WHERE bucket IS NOT NULL AND month >= '1995-06' GROUP BY 1, 2, 3, 4, 5, 6, 7
  HAVING sum(line_initiation) > 0),
prioritised AS (
  SELECT * FROM classified
  QUALIFY list_position(['After both', 'After one', 'First line', 'Naive'], bucket)
        = min(list_position(['After both', 'After one', 'First line', 'Naive'], bucket))
          OVER (PARTITION BY patient_id, month, line))"""

ORACLE_SQL["bucket_classified"] = f"WITH {_LINES} SELECT * FROM classified"
ORACLE_SQL["bucket_priority"] = f"WITH {_LINES} SELECT * FROM prioritised"
ORACLE_SQL["bucket_priority_unknown"] = (
    f"WITH {_LINES} SELECT * FROM prioritised WHERE patient_id % 10 <> 0"
)

_FOCAL = "CASE WHEN regimen_class = 'Focal' THEN patients ELSE 0 END"
_BY_BUCKET = "OVER (PARTITION BY bucket, month)"
_MARKET_SHARE = _round(
    _ratio(f"sum({_FOCAL}) {_BY_BUCKET}", f"sum(patients) {_BY_BUCKET}"), 4
)
ORACLE_SQL["concordance_market"] = f"""WITH {_LINES}
SELECT DISTINCT patient_id, line, month, regimen_class, patients, bucket,
       CAST(sum(patients) {_BY_BUCKET} AS BIGINT) AS total_patients,
       {_MARKET_SHARE} AS concordance,
       CAST(sum(CASE WHEN eligible = 1 THEN patients END) {_BY_BUCKET} AS BIGINT)
         AS eligible_patients_seen
FROM prioritised"""

ORACLE_SQL["concordance_provider"] = f"""WITH {_LINES}
SELECT provider_id, month, bucket, CAST(sum(patients) AS BIGINT) AS total_patients,
       CAST(sum({_FOCAL}) AS BIGINT) AS focal_patients,
       CAST(sum(CASE WHEN eligible = 1 THEN patients ELSE 0 END) AS BIGINT) AS eligible_patients_seen,
       {_round(_ratio(f"sum({_FOCAL})", "sum(patients)"), 4)} AS concordance
FROM prioritised GROUP BY 1, 2, 3"""

_STARTS = f"""{FILLS},
monthly AS (
  SELECT provider_id, CAST(date_trunc('month', service_date) AS DATE) AS month,
         count(DISTINCT entity_id) AS monthly_new_starts
  FROM fills WHERE product = 'Brand#7' AND new_start = 1 AND service_date >= DATE '1996-01-01'
    AND provider_id IS NOT NULL
  GROUP BY 1, 2 HAVING count(DISTINCT entity_id) > 0),
cumulative AS (
  SELECT *, CAST(sum(monthly_new_starts) OVER (PARTITION BY provider_id ORDER BY month
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_new_starts
  FROM monthly)"""

ORACLE_SQL["provider_cumulative_distinct"] = f"""WITH {FILLS},
starts AS (
  SELECT DISTINCT provider_id, entity_id, CAST(date_trunc('month', service_date) AS DATE) AS month FROM fills
  WHERE product = 'Brand#7' AND new_start = 1 AND service_date >= DATE '1996-01-01'
    AND provider_id IS NOT NULL AND entity_id IS NOT NULL),
totals AS (
  SELECT m.provider_id, m.month, count(DISTINCT s.entity_id) AS upto,
         count(DISTINCT s.entity_id) FILTER (s.month < m.month) AS before
  FROM (SELECT DISTINCT provider_id, month FROM starts) m
  JOIN starts s ON s.provider_id = m.provider_id AND s.month <= m.month GROUP BY 1, 2)
SELECT provider_id, month, upto - before AS new_patients, upto AS cumulative_patients
FROM totals WHERE upto > before"""
ORACLE_SQL["provider_monthly"] = f"WITH {_STARTS} SELECT * FROM monthly"
ORACLE_SQL["provider_cumulative"] = f"WITH {_STARTS} SELECT * FROM cumulative"


def _stages(exact: tuple, at_least: tuple[str, int]) -> str:
    branches = [(f"cumulative_new_starts = {n}", label) for label, n in exact]
    branches.append((f"cumulative_new_starts >= {at_least[1]}", at_least[0]))
    return f"""WITH {_STARTS}
SELECT *, {_case(branches)} AS stage FROM cumulative WHERE cumulative_new_starts > 0"""


ORACLE_SQL["stage_3bucket"] = _stages(**THREE_STAGES)
ORACLE_SQL["stage_2bucket"] = _stages(**TWO_STAGES)
ORACLE_SQL["net_new_list"] = f"""WITH {_STARTS}
SELECT provider_id, min(month) AS month, 1 AS is_net_new FROM monthly GROUP BY 1"""
ORACLE_SQL["net_new_summary"] = f"""WITH {_STARTS},
first_month AS (SELECT provider_id, min(month) AS month FROM monthly GROUP BY 1)
SELECT month, count(DISTINCT provider_id) AS net_new_providers,
       CAST(sum(count(DISTINCT provider_id)) OVER (ORDER BY month) AS BIGINT) AS cumulative_net_new
FROM first_month GROUP BY month"""

_EPISODES = f"""{FILLS},
sequenced AS (
  SELECT entity_id, product, claim_id, provider_id, strength, quantity, days_supply, {TIES},
         service_date AS fill_date,
         CAST(year(service_date) - nullif(birth_year, 0) AS INTEGER) AS patient_age, new_start,
         lead(service_date) OVER w AS next_fill_date,
         CAST(sum(new_start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS episode
  FROM fills WHERE product IN ('Brand#7', 'Brand#12') AND service_date >= DATE '1996-04-01'
  WINDOW w AS (PARTITION BY entity_id, product ORDER BY service_date, {TIES})),
episodes AS (
  SELECT *, min(fill_date) OVER (PARTITION BY entity_id, product, episode) AS first_date
  FROM sequenced)"""

ORACLE_SQL["fill_episodes"] = f"WITH {_EPISODES} SELECT * FROM episodes"
ORACLE_SQL["fill_episodes_hot_keys"] = ORACLE_SQL["fill_episodes"].replace(
    "FROM fills WHERE product",
    "FROM (SELECT * REPLACE (CASE WHEN entity_id % 5 = 0 THEN 0 ELSE entity_id END AS entity_id)"
    " FROM fills) WHERE product",
)

ORACLE_SQL["fill_episodes_one_day"] = ORACLE_SQL["fill_episodes"].replace(
    "FROM fills WHERE product", f"FROM {_ONE_DAY} WHERE product"
)


def _schedule(days: str) -> str:
    def branches(applies: str, expected: str, tolerance: int, weeks: int) -> str:
        return f"""
              WHEN {applies} AND {days} BETWEEN {expected} - {tolerance} AND {expected} + {tolerance}
                THEN '1 injection in {weeks} weeks'
              WHEN {applies} AND {days} < {expected} - {tolerance} THEN '1 injection in <{weeks} weeks'
              WHEN {applies} AND {days} > {expected} + {tolerance} THEN '1 injection in >{weeks} weeks'"""

    return (
        "CASE"
        + branches(
            "product = 'Brand#7' AND strength ILIKE '%40%' AND quantity % 3 = 0",
            "(quantity / 3) * 14",
            7,
            2,
        )
        + branches(
            "product = 'Brand#7' AND strength ILIKE '%25%'",
            "round(quantity / CAST(1.4 AS DOUBLE), 0) * 14",
            7,
            2,
        )
        + branches(
            "product = 'Brand#12' AND strength ILIKE '%40%' AND quantity % 5 = 0",
            "(quantity / 5) * 28",
            7,
            4,
        )
        + "\n              ELSE 'Non-Categorized' END"
    )


_TO_NEXT = "datediff('day', fill_date, next_fill_date)"
_DOSING = f"""{_EPISODES},
dosing AS (
  SELECT product, claim_id, provider_id, entity_id, fill_date, first_date, quantity, strength, days_supply,
         CAST(datediff('day', first_date, fill_date) AS INTEGER) AS days_after_first_fill,
         CAST({_TO_NEXT} AS INTEGER) AS days_before_next_fill,
         {_schedule("days_supply")} AS dosing,
         {_schedule(_TO_NEXT)} AS dosing_actual
  FROM episodes WHERE patient_age >= 9)"""

ORACLE_SQL["dosing_schedule"] = f"WITH {_DOSING} SELECT * FROM dosing"
ORACLE_SQL["dosing_consolidated"] = f"""WITH {_DOSING}
SELECT d.*, s_nationkey AS specialty_code, n_name AS specialty_name, n_regionkey AS specialty_group
FROM dosing d LEFT JOIN supplier ON d.provider_id = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey"""

ORACLE_SQL["route_rules"] = f"""WITH {FILLS}
SELECT claim_id, product, source, proc_code, ndc, strength, generic_name, provider_id, service_date,
       CASE WHEN product = 'Brand#1' AND ((source = 'MX' AND proc_code IN ('PROMO', 'LARGE'))
                 OR (source = 'MX' AND ndc IS NULL AND proc_code IN ('SMALL'))
                 OR (source = 'RX' AND strength IN ('40 UNITS'))) THEN 'IV'
            WHEN product = 'Brand#1' THEN 'SC'
            WHEN product = 'Brand#2' AND generic_name <> 'small ring' THEN 'IV'
            WHEN product = 'Brand#2' THEN 'SC'
            WHEN product = 'Brand#3' THEN 'ORAL'
            WHEN product = 'Brand#4' AND ndc IN ('11', '12', '13') THEN 'IV'
            WHEN product = 'Brand#4' THEN 'SC' ELSE '-' END AS route
FROM fills"""
ORACLE_SQL["route_rules_table"] = ORACLE_SQL["route_rules"]
ORACLE_SQL["route_rules_general"] = ORACLE_SQL["route_rules"].replace(
    "CASE WHEN product", "CASE WHEN source = 'MX' AND proc_code = 'PROMO' THEN 'MAIL' WHEN product", 1
).replace("ELSE '-'", "WHEN ndc IS NULL THEN 'OTHER' ELSE '-'")

ORACLE_SQL["detailed_providers"] = f"""WITH {CALLS}
SELECT DISTINCT provider_id FROM calls
WHERE product = 'Brand#5' AND department = 'FIELD'
  AND classification NOT IN ('PARCEL', 'FAIR') AND purpose = 'OUTBOUND'
  AND activity_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND contact_type = 'BUYER'"""

ORACLE_SQL["age_group_writers"] = f"""WITH {FILLS}
SELECT DISTINCT provider_id FROM fills
WHERE new_start = 1 AND service_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31'
  AND birth_year <> 0 AND year(service_date) - birth_year < 9"""

_POPULATIONS = f"""{FILLS},
pop_a AS (
  SELECT entity_id, product, service_date, claim_id, product_class,
         CASE WHEN generic_name LIKE '%ring%' THEN 'Rings' WHEN generic_name LIKE '%widget%' THEN 'Widgets'
              WHEN generic_name LIKE '%bolt%' THEN 'Bolts' ELSE product END AS main_product
  FROM fills WHERE product_class IN {A} AND service_date BETWEEN DATE '2001-01-01' AND DATE '2001-03-31'),
pop_b AS (
  SELECT entity_id, product, service_date, claim_id,
         CASE WHEN ndc IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'LARGE')
              THEN 1 ELSE 0 END AS full_market,
         CASE WHEN ndc IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand IN ('Brand#3', 'Brand#7'))
              THEN 1 ELSE 0 END AS sub_market
  FROM fills WHERE product_class IN {B} AND service_date BETWEEN DATE '2001-02-01' AND DATE '2001-04-30'),
recent_a AS (
  SELECT entity_id, max(CASE WHEN rn = 1 THEN main_product END) AS a_product,
         max(CASE WHEN product_class = 'PROMO' AND rn_class = 1 THEN main_product END) AS a_subset_product
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY service_date DESC, claim_id DESC) AS rn,
               row_number() OVER (PARTITION BY entity_id, product_class
                                  ORDER BY service_date DESC, claim_id DESC) AS rn_class FROM pop_a)
  GROUP BY 1),
recent_b AS (
  SELECT entity_id, max(CASE WHEN rn = 1 THEN product END) AS b_product,
         max(CASE WHEN sub_market = 1 AND rn_sub = 1 THEN product END) AS b_subset_product
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY service_date DESC, claim_id DESC) AS rn,
               row_number() OVER (PARTITION BY entity_id, sub_market
                                  ORDER BY service_date DESC, claim_id DESC) AS rn_sub FROM pop_b)
  GROUP BY 1),
both_pops AS (SELECT DISTINCT a.entity_id FROM pop_a a JOIN pop_b b ON a.entity_id = b.entity_id)"""

ORACLE_SQL["product_remap"] = f"WITH {_POPULATIONS} SELECT * FROM pop_a"
ORACLE_SQL["market_flags"] = f"WITH {_POPULATIONS} SELECT * FROM pop_b"
ORACLE_SQL["overlap_patients"] = f"WITH {_POPULATIONS} SELECT * FROM both_pops"
ORACLE_SQL["recent_products_a"] = f"WITH {_POPULATIONS} SELECT * FROM recent_a"
ORACLE_SQL["recent_products_b"] = f"WITH {_POPULATIONS} SELECT * FROM recent_b"
ORACLE_SQL["overlap_recent"] = f"""WITH {_POPULATIONS}
SELECT p.entity_id, a_product, a_subset_product, b_product, b_subset_product
FROM both_pops p LEFT JOIN recent_a a ON a.entity_id = p.entity_id
LEFT JOIN recent_b b ON b.entity_id = p.entity_id"""

# -- checks, KPIs and search -------------------------------------------------------------

ORACLE_SQL["fanout_check"] = f"""WITH {FILLS}
SELECT count(*) AS total_rows, count(DISTINCT entity_id) AS distinct_entities,
       count(*) - count(entity_id) AS unknown_rows FROM fills"""

ORACLE_SQL["fanout_offenders"] = f"""WITH {CLAIMS}
SELECT entity_id, service_date, count(*) AS rows FROM claims GROUP BY 1, 2 HAVING count(*) > 1"""

ORACLE_SQL["join_fanout"] = f"""WITH {CLAIMS},
joined AS (SELECT c.claim_id FROM claims c JOIN lineitem l ON c.claim_id = l.l_orderkey),
sizes AS (
  SELECT (SELECT count(*) FROM claims) AS total_rows_before,
         (SELECT count(*) FROM joined) AS total_rows_after,
         (SELECT count(DISTINCT claim_id) FROM claims) AS distinct_entities_before,
         (SELECT count(DISTINCT claim_id) FROM joined) AS distinct_entities_after)
SELECT *, {_ratio("total_rows_after", "total_rows_before")} AS row_multiplier FROM sizes"""


def _profile(table: str, columns: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS data_type,
       count(*) AS row_count, count(*) - count({name}) AS null_count,
       count(DISTINCT {name}) AS distinct_count, CAST(min({name}) AS VARCHAR) AS min_value,
       CAST(max({name}) AS VARCHAR) AS max_value FROM {table}"""
        for i, (name, kind) in enumerate(columns)
    )


ORACLE_SQL["profile_table"] = _profile(
    "orders",
    [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "string"),
        ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "string"),
    ],
)


def _grain(keys: str) -> str:
    return f"""SELECT '{keys}' AS candidate_key, CAST(sum(n) AS BIGINT) AS total_rows,
       count(*) AS distinct_keys, count(CASE WHEN n > 1 THEN 1 END) AS repeated_keys,
       max(n) AS max_rows_per_key, CASE WHEN max(n) = 1 THEN 1 ELSE 0 END AS is_unique
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {keys})"""


ORACLE_SQL["grain_check"] = "\nUNION ALL\n".join(
    _grain(k) for k in ("l_orderkey", "l_orderkey, l_linenumber", f"{TIES}, l_shipdate")
)

ORACLE_SQL["join_cardinality"] = f"""WITH {CLAIMS}, {CALLS},
l AS (SELECT entity_id, count(*) AS n FROM claims GROUP BY 1),
r AS (SELECT entity_id, count(*) AS n FROM calls GROUP BY 1),
matched AS (SELECT l.n AS ln, r.n AS rn FROM l JOIN r ON l.entity_id = r.entity_id),
left_only AS (SELECT * FROM l WHERE entity_id NOT IN (SELECT entity_id FROM r)),
right_only AS (SELECT * FROM r WHERE entity_id NOT IN (SELECT entity_id FROM l))
SELECT (SELECT count(*) FROM claims) AS left_rows, (SELECT count(*) FROM calls) AS right_rows,
       (SELECT count(*) FROM matched) AS matched_keys, (SELECT count(*) FROM left_only) AS left_only_keys,
       (SELECT count(*) FROM right_only) AS right_only_keys,
       CAST((SELECT coalesce(sum(n), 0) FROM left_only) AS BIGINT) AS left_unmatched_rows,
       CAST((SELECT coalesce(sum(n), 0) FROM right_only) AS BIGINT) AS right_unmatched_rows,
       CAST((SELECT count(*) FROM claims c JOIN calls k ON c.entity_id = k.entity_id) AS DOUBLE) AS joined_rows,
       (SELECT max(ln) FROM matched) AS max_left_rows_per_key,
       (SELECT max(rn) FROM matched) AS max_right_rows_per_key,
       CASE WHEN (SELECT max(ln) FROM matched) > 1 AND (SELECT max(rn) FROM matched) > 1 THEN 'N:M'
            WHEN (SELECT max(ln) FROM matched) > 1 THEN 'N:1'
            WHEN (SELECT max(rn) FROM matched) > 1 THEN '1:N' ELSE '1:1' END AS cardinality"""

GRAIN_TABLES = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}
_SETS = "\n  UNION ALL ".join(
    f"SELECT '{table}' AS table_name, {list(s)} AS cols, (SELECT count(*) FROM {table}) AS total_rows, "
    f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {table})) AS distinct_keys"
    for table, columns in GRAIN_TABLES.items()
    for width in (1, 2, 3)
    for s in combinations(columns, width)
)
ORACLE_SQL["grain_discover"] = f"""WITH sets AS (
  {_SETS}),
keys AS (SELECT * FROM sets WHERE total_rows = distinct_keys AND total_rows > 0)
SELECT table_name, array_to_string(cols, ', ') AS grain, CAST(len(cols) AS INTEGER) AS width, total_rows
FROM keys k WHERE NOT EXISTS (
  SELECT 1 FROM keys s WHERE s.table_name = k.table_name AND len(s.cols) < len(k.cols)
  AND list_has_all(k.cols, s.cols))"""

#: Columns of one type family; floating numbers are no keys.
WHOLE = {
    "orders": ["o_orderkey", "o_custkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "part": ["p_partkey", "p_size"],
    "nation": ["n_nationkey", "n_regionkey"],
    "events": ["event_id", "user_id"],
}
TEXT = {
    "orders": ["o_orderstatus", "o_orderpriority"],
    "customer": ["c_name", "c_mktsegment"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "part": ["p_name", "p_brand", "p_type"],
    "nation": ["n_name"],
    "events": ["event_type", "props"],
}


def _shared(left: str, right: str, least: float) -> str:
    pairs = "\n  UNION ALL ".join(
        f"""SELECT '{left}' AS left_table, '{right}' AS right_table, '{a}' AS left_column, '{b}' AS right_column,
    (SELECT count(DISTINCT {a}) FROM {left}) AS left_distinct,
    (SELECT count(DISTINCT {a}) FROM {left} WHERE {a} IN (SELECT {b} FROM {right} WHERE {b} IS NOT NULL))
      AS matched_distinct,
    (SELECT count(DISTINCT {b}) FROM {right}) AS right_distinct,
    (SELECT CASE WHEN count({b}) = count(DISTINCT {b}) THEN 1 ELSE 0 END FROM {right}) AS right_is_unique"""
        for family in (WHOLE, TEXT)
        for a in family[left]
        for b in family[right]
    )
    share = _ratio("matched_distinct", "left_distinct")
    return f"""SELECT *, {share} AS containment FROM (
  {pairs}) WHERE matched_distinct >= {least} * left_distinct AND left_distinct > 0"""


ORACLE_SQL["join_keys"] = "\nUNION ALL\n".join(
    _shared(left, right, 1) for left, right in (("orders", "customer"), ("lineitem", "part"), ("customer", "nation"))
)
ORACLE_SQL["join_keys_partial"] = _shared("events", "customer", 0.5)

ORACLE_SQL["fanout_heavy_keys"] = f"""WITH {FILLS},
known AS (SELECT entity_id FROM fills WHERE entity_id IS NOT NULL)
SELECT entity_id, count(*) AS rows, {_ratio("count(*)", "(SELECT count(*) FROM known)")} AS share
FROM known GROUP BY 1 ORDER BY rows DESC, entity_id LIMIT 25"""

ORACLE_SQL["profile_merged"] = f"""SELECT * EXCLUDE (distinct_count), 1 AS distinct_is_close
FROM ({ORACLE_SQL["profile_table"]})"""

FUNNEL = ("signup", "view", "click", "purchase")


def _chains() -> str:
    """For each step the latest start of every chain, by joins of days."""
    out = []
    for i, step in enumerate(FUNNEL):
        days = f"(SELECT DISTINCT entity_id, activity_date AS day FROM calls WHERE activity_type = '{step}')"
        if i == 0:
            out.append(f"chain0 AS (SELECT entity_id, day, day AS start FROM {days})")
        else:
            out.append(
                f"chain{i} AS (SELECT e.entity_id, e.day, max(c.start) AS start FROM {days} e "
                f"JOIN chain{i - 1} c ON c.entity_id = e.entity_id AND c.day <= e.day AND e.day - c.start <= 90 "
                "GROUP BY 1, 2)"
            )
    return ",\n".join(out)


_REACHED = "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS step_number, '{s}' AS step, count(DISTINCT entity_id) AS entities FROM chain{i}"
    for i, s in enumerate(FUNNEL)
)
_PREVIOUS = "coalesce(lag(entities) OVER (ORDER BY step_number), entities)"
ORACLE_SQL["funnel_ordered"] = f"""WITH {CALLS}, {_chains()},
reached AS ({_REACHED}),
placed AS (SELECT *, {_PREVIOUS} AS previous, first_value(entities) OVER (ORDER BY step_number) AS first FROM reached)
SELECT step_number, step, entities, {_pct("entities", "previous")} AS pct_of_previous,
       {_pct("entities", "first")} AS pct_of_first FROM placed"""

ORACLE_SQL["freshness"] = f"""WITH {FILLS}
SELECT max(service_date) AS latest_record_date,
       CAST(datediff('day', max(service_date), DATE '2001-12-31') AS INTEGER) AS lag_days FROM fills"""

ORACLE_SQL["segment_counts"] = f"""WITH {_SEGMENTED}
SELECT segment, count(*) AS n FROM segmented GROUP BY 1"""

ORACLE_SQL["segment_exclusivity"] = f"""WITH {_SEGMENTED}
SELECT CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'one' ELSE 'several' END AS status,
       count(*) AS entities
FROM (SELECT entity_id, count(DISTINCT segment) AS k FROM segmented GROUP BY 1) GROUP BY 1"""

_KPIS = f"""{CLAIMS}, {CUSTOMERS},
placed AS (SELECT c.*, k.region FROM claims c LEFT JOIN customers k ON c.entity_id = k.entity_id),
results AS (
  SELECT 'Monthly paid' AS kpi, '' AS grain, '' AS grain_key,
         CAST(date_trunc('month', service_date) AS DATE) AS period,
         CAST(sum(paid_amount) AS DOUBLE) AS value
  FROM placed WHERE service_date >= DATE '2000-08-01' GROUP BY 4
  UNION ALL
  SELECT 'Active entities (region)', 'region', coalesce(region, '\\N'),
         CAST(date_trunc('month', service_date) AS DATE), CAST(count(DISTINCT entity_id) AS DOUBLE)
  FROM placed WHERE date_trunc('month', service_date) BETWEEN DATE '2000-01-01' AND DATE '2001-06-30'
  GROUP BY 3, 4
  UNION ALL
  SELECT 'Large claims', 'region', coalesce(region, '\\N'),
         CAST(date_trunc('month', service_date) AS DATE), CAST(sum(paid_amount) AS DOUBLE)
  FROM placed
  WHERE paid_amount >= 100000 AND region IS DISTINCT FROM 'ASIA' AND order_status IS DISTINCT FROM 'P'
    AND date_trunc('month', service_date) BETWEEN DATE '2000-02-01' AND DATE '2001-08-01'
  GROUP BY 3, 4)"""

ORACLE_SQL["kpi_run"] = f"""WITH {_KPIS}
SELECT *, trim(regexp_replace(lower(kpi), '[^a-z0-9]+', '-', 'g'), '-') AS kpi_id FROM results"""
ORACLE_SQL["kpi_consistency"] = f"""WITH {_KPIS}, per_kpi AS (
  SELECT kpi, grain, min(period) AS first_period, max(period) AS last_period,
         count(DISTINCT period) AS periods, count(DISTINCT grain_key) AS grain_keys,
         count(*) - count(DISTINCT (period, grain_key)) AS repeated_cells
  FROM results GROUP BY 1, 2)
SELECT *, CASE WHEN (SELECT count(DISTINCT grain) FROM per_kpi) = 1 THEN 1 ELSE 0 END AS same_grain,
       CASE WHEN (SELECT count(DISTINCT (first_period, last_period)) FROM per_kpi) = 1
            THEN 1 ELSE 0 END AS same_window
FROM per_kpi"""
ORACLE_SQL["kpi_missing"] = f"""WITH {_KPIS},
kpis AS (SELECT * FROM (VALUES ('Monthly paid', ''), ('Active entities (region)', 'region'),
                               ('Large claims', 'region')) AS k(kpi, grain)),
cells AS (SELECT DISTINCT grain, period, grain_key FROM results)
SELECT k.kpi, c.grain, c.period, c.grain_key FROM cells c JOIN kpis k ON k.grain = c.grain
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.kpi = k.kpi AND r.grain = c.grain
                  AND r.period = c.period AND r.grain_key = c.grain_key)"""

ORACLE_SQL["kpi_run_one_pass"] = f"""WITH {CLAIMS}, {CUSTOMERS},
placed AS (SELECT c.*, k.region, CAST(date_trunc('month', service_date) AS DATE) AS month
           FROM claims c LEFT JOIN customers k ON c.entity_id = k.entity_id),
results AS (
  SELECT 'Paid' AS kpi, '' AS grain, '' AS grain_key, month AS period, CAST(sum(paid_amount) AS DOUBLE) AS value
  FROM placed GROUP BY 4
  UNION ALL
  SELECT 'Paid in region', 'region', coalesce(region, '\\N'), month, CAST(sum(paid_amount) AS DOUBLE)
  FROM placed WHERE order_status IS DISTINCT FROM 'P' GROUP BY 3, 4
  UNION ALL
  SELECT 'Active entities', 'region', coalesce(region, '\\N'), month, CAST(count(DISTINCT entity_id) AS DOUBLE)
  FROM placed WHERE month BETWEEN DATE '2000-01-01' AND DATE '2001-06-30' GROUP BY 3, 4
  UNION ALL
  SELECT 'Largest claim', 'region, order_status', coalesce(region, '\\N') || '|' || coalesce(order_status, '\\N'),
         month, CAST(max(paid_amount) AS DOUBLE)
  FROM placed WHERE paid_amount < 200000 GROUP BY 3, 4
  UNION ALL
  SELECT 'Statuses in use', 'order_status', coalesce(order_status, '\\N'), month,
         CAST(count(DISTINCT order_status) AS DOUBLE)
  FROM placed WHERE month BETWEEN DATE '2000-08-01' AND DATE '2001-08-01' GROUP BY 3, 4
  UNION ALL
  SELECT 'Urgent claims', '', '', month, CAST(count(*) AS DOUBLE) FROM placed WHERE priority = '1-URGENT' GROUP BY 4)
SELECT *, trim(regexp_replace(lower(kpi), '[^a-z0-9]+', '-', 'g'), '-') AS kpi_id FROM results"""

ORACLE_SQL["kpi_run_patterns"] = f"""WITH results AS (
  SELECT 'Change on last year' AS kpi, 'entity_id' AS grain, CAST(entity_id AS VARCHAR) AS grain_key,
         CAST(NULL AS DATE) AS period, CAST(yoy_abs_change AS DOUBLE) AS value
  FROM ({ORACLE_SQL["yoy"]})
  UNION ALL
  SELECT 'Claims funnel', '', '', NULL,
         CAST((SELECT count(*) FROM customer WHERE c_acctbal >= 0
               AND c_custkey IN (SELECT o_custkey FROM orders)) AS DOUBLE)
  UNION ALL
  SELECT 'Largest claims', 'order_status, claim_id', order_status || '|' || CAST(claim_id AS VARCHAR),
         NULL, CAST(overall_rank AS DOUBLE)
  FROM ({ORACLE_SQL["topn"]}) WHERE overall_rank <= 20
  UNION ALL
  SELECT 'Concordance', 'bucket, patient_id, line, regimen_class',
         concat_ws('|', bucket, patient_id, line, regimen_class), CAST(month || '-01' AS DATE), concordance
  FROM ({ORACLE_SQL["concordance_market"]})
  UNION ALL
  SELECT 'Segments', 'segment', segment, NULL, CAST(n AS DOUBLE) FROM ({ORACLE_SQL["segment_counts"]}))
SELECT *, trim(regexp_replace(lower(kpi), '[^a-z0-9]+', '-', 'g'), '-') AS kpi_id FROM results"""

_MESSAGES = """messages AS (
  SELECT conv_id AS thread_id, turn AS seq,
         TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 3650 AS INTEGER)) + to_minutes(turn) AS ts,
         role AS sender, text,
         (SELECT max(t.text) FROM conversations t
          WHERE t.conv_id = c.conv_id AND t.turn = 0) AS subject
  FROM conversations c)"""
_HIT = """(contains(lower(text), 'heon') OR contains(lower(text), 'eaux'))
    AND sender IN ('user', 'system')"""

ORACLE_SQL["thread_search"] = f"""WITH {_MESSAGES},
recent AS (SELECT * FROM messages WHERE CAST(ts AS DATE) BETWEEN DATE '2024-02-01' - 30 AND DATE '2024-02-01')
SELECT thread_id, seq, CAST(ts AS DATE) AS sent_date, sender, subject, text FROM recent
WHERE thread_id IN (SELECT thread_id FROM recent WHERE {_HIT})"""

ORACLE_SQL["thread_search_whole"] = f"""WITH {_MESSAGES}
SELECT thread_id, seq, CAST(ts AS DATE) AS sent_date, sender, subject, text FROM messages
WHERE thread_id IN (
  SELECT thread_id FROM messages WHERE CAST(ts AS DATE) BETWEEN DATE '2024-02-01' - 30 AND DATE '2024-02-01'
  AND (contains(lower(text), 'heon') OR contains(lower(text), 'eaux'))
  AND (lower(sender) IN ('user', 'system') OR lower(subject) IN ('user', 'system')))"""

ORACLE_SQL["thread_latest"] = f"""WITH {_MESSAGES}
SELECT thread_id, seq, CAST(ts AS DATE) AS sent_date, sender, subject, text FROM messages
WHERE thread_id IN (SELECT thread_id FROM messages WHERE {_HIT}
                    AND (contains(lower(subject), 'th') OR contains(lower(subject), 'de')))
QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY ts DESC, seq DESC) = 1"""
