"""Two populations side by side, and group values that ignore a view's filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exprs import (
    DateLike,
    Names,
    between_days,
    flag,
    names,
    or_zero,
    ratio,
    require_columns,
)
from kpiloom.functions.tiers import first_match_column


def fixed_average(
    df: DataFrame,
    group: Names,
    value: str,
    entity: str,
    view: Column | None = None,
    view_by: Names = (),
    places: DataFrame | None = None,
) -> DataFrame:
    """Group averages fixed against a view's filter, next to the averages inside the view.

    ``view`` is the filter of the report and ``view_by`` its further dimensions. The fixed
    average is over all rows of the group; filter ``df`` beforehand for conditions it should
    respect. The rows are summed per entity and view dimension first; only these sums meet
    ``places``, which has the group columns with one row per entity if the rows don't. Both
    levels are grouping sets over the sums, and the group's own line is then handed to its view
    lines: a window over aggregated lines, not over rows.
    """
    fixed_on, dims = names(group), names(view_by)
    require_columns(df, dims, value, entity)
    require_columns(df if places is None else places, entity, fixed_on)
    inside = F.lit(True) if view is None else view
    in_view = F.when(inside, F.col(value))
    own = [] if places is not None else fixed_on
    df = df.groupBy(*dict.fromkeys([entity, *own, *dims])).agg(
        F.sum(value).alias("__sum"),
        F.count(value).alias("__rows"),
        F.count_if(inside).alias("__inside"),
        F.sum(in_view).alias("__view_sum"),
        F.count(in_view).alias("__view_count"),
    )
    if places is not None:
        df = df.join(places.select(entity, *fixed_on), entity, "left")
    measures = [
        F.sum("__sum").alias("__sum"),
        F.sum("__rows").alias("__rows"),
        F.count_distinct(entity).alias("__entities"),
        F.sum("__inside").alias("view_rows"),
        ratio(F.sum("__view_sum"), F.sum("__view_count")).alias("view_avg"),
    ]
    keys = [*fixed_on, *dims]
    if dims:
        levels = [[F.col(c) for c in keys], [F.col(c) for c in fixed_on]]
        lines = df.groupingSets(levels, *keys).agg(F.grouping_id().alias("__level"), *measures)
    else:
        lines = df.groupBy(*keys).agg(F.lit(0).alias("__level"), *measures)
    # the group's own line has its dimensions grouped away; without dimensions it is the only one
    own = F.lit(True) if not dims else F.col("__level") > 0
    of_group = Window.partitionBy(*fixed_on)

    def fixed(average: Column) -> Column:
        return F.max(F.when(own, average)).over(of_group)

    handed = lines.withColumns(
        {
            "fixed_avg": fixed(ratio(F.col("__sum"), F.col("__rows"))),
            "fixed_avg_per_entity": fixed(ratio(F.col("__sum"), F.col("__entities"))),
        }
    )
    return handed.filter("__level = 0 AND view_rows > 0").select(
        *keys, "view_rows", "view_avg", "fixed_avg", "fixed_avg_per_entity"
    )


def product_remap(
    fills: DataFrame,
    patterns: Sequence[tuple[str, str]],
    first: DateLike,
    last: DateLike,
    where: Column | None = None,
) -> DataFrame:
    """Fills of a population with name variants collapsed to one product.

    ``patterns`` are (text in the generic name, product), the first match wins; other fills
    keep their product.
    """
    require_columns(
        fills, "entity_id", "product", "service_date", "claim_id", "product_class", "generic_name"
    )
    rows = fills.filter(between_days("service_date", first, last))
    if where is not None:
        rows = rows.filter(where)
    generic = F.col("generic_name")
    tiers = [(F.lit(product), generic.contains(text)) for text, product in patterns]
    return rows.select(
        *["entity_id", "product", "service_date", "claim_id", "product_class"],
        first_match_column(tiers, F.col("product")).alias("main_product"),
    )


def market_flags(
    fills: DataFrame,
    lookup: DataFrame,
    basket: str,
    products: Sequence[str],
    first: DateLike,
    last: DateLike,
    where: Column | None = None,
) -> DataFrame:
    """Fills of a population with 0/1 membership of their code in two lookup sets.

    The lookup is reduced to one row per code with both memberships, so one join that cannot
    multiply rows serves both flags. Codes that are unknown belong to neither set.
    """
    require_columns(fills, "entity_id", "product", "service_date", "claim_id", "ndc")
    require_columns(lookup, "ndc", "market_basket", "product")
    rows = fills.filter(between_days("service_date", first, last))
    if where is not None:
        rows = rows.filter(where)
    codes = (
        lookup.filter((F.col("market_basket") == basket) | F.col("product").isin(*products))
        .groupBy("ndc")
        .agg(
            F.max(flag(F.col("market_basket") == basket)).alias("__full"),
            F.max(flag(F.col("product").isin(*products))).alias("__sub"),
        )
    )
    return rows.join(codes, "ndc", "left").select(
        *["entity_id", "product", "service_date", "claim_id"],
        or_zero("__full").alias("full_market"),
        or_zero("__sub").alias("sub_market"),
    )


def overlap_patients(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct entities present in both populations."""
    require_columns(a, "entity_id")
    require_columns(b, "entity_id")
    return a.select("entity_id").distinct().join(
        b.select("entity_id").distinct(), "entity_id", "left_semi"
    )


def recent_products(
    fills: DataFrame, product: str, only: Column, prefix: str, tiebreak: Names = "claim_id"
) -> DataFrame:
    """Latest product per entity, overall and among the rows where ``only`` holds.

    ``max_by`` keeps one candidate per entity and map task; no row-level window is needed.
    """
    require_columns(fills, "entity_id", product, "service_date", tiebreak)
    order = F.struct("service_date", *names(tiebreak))
    return fills.groupBy("entity_id").agg(
        F.max_by(product, order).alias(f"{prefix}_product"),
        F.max_by(F.when(only, F.col(product)), F.when(only, order)).alias(
            f"{prefix}_subset_product"
        ),
    )


def overlap_recent(recent_a: DataFrame, recent_b: DataFrame) -> DataFrame:
    """Entities of both populations with their latest products in each.

    Each side has one row for every entity of its population, so the inner join is the
    overlap; it must not become an outer one.
    """
    return recent_a.join(recent_b, "entity_id")
