"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.sources.stage import reliable_copy


def _state(links: DataFrame) -> tuple:
    """Row count and checksum: two equal states are taken as the same links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    heads = both.groupBy("a").agg(F.least("a", F.min("b")).alias("head"))
    return (
        both.join(heads, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("head").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them. Needs a > b."""
    heads = links.groupBy("a").agg(F.min("b").alias("head"))
    tied = links.join(heads, "a").where("b > head").select(F.col("b").alias("a"), "head")
    return tied.unionByName(heads).select("a", F.col("head").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``head``: the smallest node of each linked node's component, the head included.

    ``links`` has two columns of one type; order, repeats and links of a node to itself don't matter.
    Alternates large-star and small-star steps. Each step is a grouping and a join on node ids, never
    pairs of a group, and each round is written to the shared checkpoint folder.
    """
    x, y = links.columns
    links = links.where(F.col(x) != F.col(y)).select(
        F.greatest(x, y).alias("a"), F.least(x, y).alias("b")
    )
    links = reliable_copy(links.distinct())
    state, before = _state(links), None
    while state != before:
        links = reliable_copy(_small_star(_large_star(links)))
        state, before = _state(links), state
    heads = links.select("b").distinct()
    return links.unionByName(heads.select(F.col("b").alias("a"), "b")).toDF("node", "head")
