"""The neutral tables the operators read, bound to the star-schema test tables.

Each function returns only the columns asked for and joins only the tables those columns need.
Dimensions are joined left on their primary key, so leaving a join out changes no row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import between_days, day_of, flag, month_of

AS_OF = dt.date(2001, 8, 1)  # last order date of the test tables
SHIPPED_AS_OF = dt.date(2001, 11, 4)  # last ship date

# a total order over line items: (order, line) alone is not unique in the test tables
FILL_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _money(column: str) -> Column:
    """Cents as a decimal: sums do not depend on the order of the rows."""
    return F.col(column).cast("decimal(18,2)")


def customer(spark: SparkSession, folder: str) -> DataFrame:
    """entity_id, name, region, status."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    joined = (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    active = F.when(F.col("c_acctbal") >= 0, "active").otherwise("inactive")
    return joined.select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_name").alias("name"),
        F.col("r_name").alias("region"),
        active.alias("status"),
    )


def claims(spark: SparkSession, folder: str, with_region: bool = False) -> DataFrame:
    """claim_id, entity_id, service_date, paid_amount, order_status (and region)."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("entity_id"),
        day_of("o_orderdate").alias("service_date"),
        _money("o_totalprice").alias("paid_amount"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("priority"),
    )
    if with_region:
        places = customer(spark, folder).select("entity_id", "region")
        rows = rows.join(places, "entity_id", "left")
    return rows


def fills(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The asked columns of the fills table; see ``FIXTURES.md`` for their definitions."""
    supply = F.col("l_quantity") * 7 + (F.col("l_linenumber") % 5 - 2) * 7
    custkey = F.col("o_custkey")
    definitions = {
        # from the line item itself
        "provider_id": F.col("l_suppkey"),
        "service_date": day_of("l_shipdate"),
        "quantity": F.col("l_quantity"),
        "days_supply": supply.cast("int"),
        "new_start": flag(F.col("l_linenumber") == 1),
        "source": F.when(F.col("l_returnflag") == "A", "MX").otherwise("RX"),
        "ndc": F.when(F.col("l_returnflag") != "R", F.col("l_partkey").cast("string")),
        "claim_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        **{c: F.col(c) for c in FILL_TIES},
    }
    from_order = {
        "entity_id": custkey,
        "birth_year": F.when(custkey % 50 == 0, 0).otherwise(1920 + custkey % 100).cast("int"),
    }
    from_part = {
        "product": F.col("p_brand"),
        "generic_name": F.col("p_name"),
        "product_class": F.col("p_type"),
        "proc_code": F.col("p_type"),
        "strength": F.when(F.col("p_size") % 2 == 0, "40 UNITS").otherwise("25 UNITS"),
    }
    rows = table(spark, folder, "lineitem")
    if any(c in from_order for c in columns):
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if any(c in from_part for c in columns):
        part = table(spark, folder, "part")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    every = {**definitions, **from_order, **from_part}
    return rows.select(*[every[c].alias(c) for c in columns])


def roster(
    spark: SparkSession, folder: str, classes: Sequence[str], first: str, last: str
) -> DataFrame:
    """entity_id, diagnosis_date: one row per fill of the classes, so entities repeat."""
    rows = fills(spark, folder, "entity_id", "product_class", "service_date")
    return rows.filter(
        F.col("product_class").isin(*classes) & between_days("service_date", first, last)
    ).select("entity_id", F.col("service_date").alias("diagnosis_date"))


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Outreach calls derived from the event stream; attributes follow from the event number."""
    n = F.col("event_id")
    kinds = F.array(*map(F.lit, ["VISIT", "PARCEL", "FAIR", "RECALL"]))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("entity_id"),
        (n % 997).alias("provider_id"),
        F.col("event_type").alias("activity_type"),
        F.date_add(F.lit(dt.date(1995, 1, 1)), (n * 37 % 2400).cast("int")).alias("activity_date"),
        F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string")).alias("product"),
        F.when(n % 3 == 0, "DESK").otherwise("FIELD").alias("department"),
        F.when(n % 11 != 0, F.get(kinds, (n % 4).cast("int"))).alias("classification"),
        F.when(n % 5 == 0, "SUPPLY").otherwise("OUTBOUND").alias("purpose"),
        F.when(n % 7 == 0, "CREW").otherwise("BUYER").alias("contact_type"),
    )


def goals(spark: SparkSession, folder: str) -> DataFrame:
    """provider_id, month, goal_value: last year's fills plus ten percent."""
    rows = fills(spark, folder, "provider_id", "service_date")
    counted = rows.groupBy("provider_id", month_of("service_date").alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        "provider_id",
        F.add_months("m", 12).alias("month"),
        F.floor(F.lit(1.1) * F.col("n")).cast("int").alias("goal_value"),
    )


def providers(spark: SparkSession, folder: str) -> DataFrame:
    """provider_id with its specialty: supplier and nation."""
    nation = table(spark, folder, "nation")
    joined = table(spark, folder, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.select(
        F.col("s_suppkey").alias("provider_id"),
        F.col("s_nationkey").alias("specialty_code"),
        F.col("n_name").alias("specialty_name"),
        F.col("n_regionkey").alias("specialty_group"),
    )


def _account_name() -> Column:
    suffix = F.when(F.col("n_nationkey") % 6 == 0, " University").when(
        F.col("n_nationkey") % 6 == 1, " Research Park"
    ).otherwise("")
    return F.concat("n_name", suffix)


def provider_account(spark: SparkSession, folder: str) -> DataFrame:
    """Providers and their account: customers and their nation, with untrimmed names."""
    nation = table(spark, folder, "nation")
    joined = table(spark, folder, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.select(
        F.col("c_custkey").alias("provider_id"),
        F.col("c_nationkey").cast("string").alias("account_id"),
        F.concat(F.lit("  "), _account_name(), F.lit(" ")).alias("account_name"),
        F.col("c_name").alias("customer_ref"),
    )


def provider_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("provider_id"),
        (key % 3).cast("string").alias("level2_id"),
        (key % 7).cast("string").alias("level3_id"),
    )


def training(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    ends = F.date_add(F.lit(dt.date(1999, 1, 1)), (key * 13 % 1200).cast("int"))
    return table(spark, folder, "customer").select(
        key.alias("provider_id"), F.when(key % 9 != 0, ends).alias("training_to")
    )


def account_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged accounts; some carry two labels, some are listed without a flag."""
    key = F.col("n_nationkey")
    nation = table(spark, folder, "nation")
    labels = F.explode(F.array(F.lit("Community"), F.lit("Academic")))
    return (
        nation.select(key, labels.alias("label"))
        .filter((key % 5 == 2) & ((F.col("label") == "Community") | (key % 10 == 2)))
        .select(
            key.cast("string").alias("account_id"),
            "label",
            flag(key % 4 != 3).alias("flag_a"),
            flag(key % 15 == 7).alias("flag_b"),
        )
    )


def organisations(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("n_nationkey") % 4 == 0, "Integrated Delivery").otherwise("Clinic")
    return table(spark, folder, "nation").select(
        F.upper(_account_name()).alias("business_name"), kind.alias("facility_type")
    )


def therapy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line per patient and product class, numbered by the date of its first fill.

    A patient has as many lines as there are classes, so the windows here stay short; the
    first fill of a class is a minimum, not a window over all fills.
    """
    rows = fills(
        spark, folder, "entity_id", "provider_id", "product", "product_class", "service_date",
        *FILL_TIES,
    )
    first = F.min(F.struct("service_date", *FILL_TIES, "provider_id", "product"))
    per_class = rows.groupBy("entity_id", "product_class").agg(first.alias("first"))
    numbered = per_class.select(
        F.col("entity_id").alias("patient_id"),
        F.col("first.provider_id").alias("provider_id"),
        F.concat_ws(" ", "product_class", "first.product").alias("regimen"),
        "product_class",
        F.col("first.service_date").alias("start_date"),
    ).withColumn(
        "line",
        F.row_number().over(Window.partitionBy("patient_id").orderBy("start_date", "product_class")),
    )
    patient = Window.partitionBy("patient_id")

    def first_line(name: str) -> Column:
        return F.min(F.when(F.col("product_class") == name, F.col("line"))).over(patient)

    return numbered.select(
        "patient_id",
        "provider_id",
        "regimen",
        "line",
        "start_date",
        F.lit(1).alias("line_initiation"),
        first_line("PROMO").alias("first_line_a"),
        first_line("ECONOMY").alias("first_line_b"),
        first_line("LARGE").alias("first_line_focal"),
    )


def product_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("ndc"),
        F.col("p_type").alias("market_basket"),
        F.col("p_brand").alias("product"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as messages of a thread; the subject is the first turn."""
    turns = table(spark, folder, "conversations")
    subject = F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("subject")
    subjects = turns.groupBy("conv_id").agg(subject)
    sent = F.expr(
        "timestamp_ntz'2024-01-01 00:00:00'"
        " + make_dt_interval(cast(conv_id % 3650 as int), 0, cast(turn as int), 0)"
    )
    return turns.join(subjects, "conv_id", "left").select(
        F.col("conv_id").alias("thread_id"),
        F.col("turn").alias("seq"),
        sent.alias("ts"),
        F.col("role").alias("sender"),
        "subject",
        "text",
    )
