"""Ordered windows of which one group, even one key's single day, may hold most rows of a table.

A window over (key, day) still runs in one task where a day of one key is the table. Here the order itself is
cut: the edges are quantiles of (order columns) over all rows, so that a piece between two edges holds at most
about one part in ``pieces`` of all rows, whatever the keys are, undated rows included. Rows are placed by key and
piece, the window runs inside, and one row for each key and piece carries values across, as between the days of
:mod:`kpiloom.functions.hotkeys`. The price is a pass over the order columns to find the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.exprs import Names, names
from kpiloom.functions.hotkeys import BUCKET, DaySplit, stand_ins
from kpiloom.sources.stage import reliable_copy

#: Pieces for each shuffle partition: so many that their sums in the partitions differ little.
PIECES_A_PARTITION = 16
#: Sampled places of the order for each piece.
SAMPLE_A_PIECE = 8
#: Children of a node of the search tree over the edges, of which a row carries those of one node at a time.
WIDTH = 32


def default_pieces(spark: SparkSession) -> int:
    """Pieces that grow with the shuffle partitions, which grow with the cluster and its tables.

    The edges, which every task gets, and the sample, which one task sorts, grow with them as well: 16 and
    128 places of the order for each partition, 1.3 million places for 10,000 partitions.
    """
    return PIECES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_edges(df: DataFrame, order: Names, pieces: int) -> DataFrame:
    """One row with the ascending edges between the pieces.

    Different places of the order fall into hash buckets, of each of which the place with the smallest second
    hash is taken: a uniform sample of bounded size, combined on the map side, and the same on every run. As
    the places of one key differ (else their order would be open), a key and day with a share of the rows has
    at least that share of all places.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(names(order))])
    sample = (
        df.select(place.alias("place"))
        .groupBy(F.pmod(F.xxhash64("place"), F.lit(pieces * SAMPLE_A_PIECE)))
        .agg(F.min_by("place", F.xxhash64(F.lit("second"), "place")).alias("place"))
    )
    ordered = sample.agg(F.sort_array(F.collect_list("place")).alias("places"))
    # each edge once, and none from an empty table
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(max(pieces - 1, 1))),
        lambda i: F.get("places", F.floor(i * F.size("places") / pieces).cast("int")),
    )
    return ordered.select(F.array_distinct(F.array_compact(picks)).alias("edges"))


def piece_of(edges: Column, place: Column, pieces: int) -> Column:
    """How many edges are not above the place: a binary search in the sorted array."""
    steps = [1 << i for i in reversed(range(max(pieces - 1, 1).bit_length()))]

    def further(below: Column, step: Column) -> Column:
        edge = F.get(edges, below + step - 1)
        return F.when(edge.isNotNull() & (edge <= place), below + step).otherwise(below)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def with_piece(df: DataFrame, edges: DataFrame, place: Column, pieces: int) -> DataFrame:
    """``BUCKET``: how many edges are not above the place.

    The number is found digit by digit, in base ``WIDTH``: a broadcast table has the ``WIDTH`` - 1 edges that
    tell the next digit. So a row never carries all edges, whose number grows with the table.
    """
    spans = [1]
    while spans[0] * WIDTH < pieces:
        spans.insert(0, spans[0] * WIDTH)
    # stored, as it is read once for each digit and use of the rows
    placed = reliable_copy(edges.select(F.posexplode("edges").alias("n", "edge")).withColumn("n", F.col("n") + 1))
    df = df.withColumns({"__place": place, BUCKET: F.lit(0)})
    for span in spans:
        own = placed.where((F.col("n") % span == 0) & (F.col("n") % (span * WIDTH) != 0))
        own = own.groupBy((F.col("n") - F.col("n") % (span * WIDTH)).alias("__from"))
        own = own.agg(F.sort_array(F.collect_list("edge")).alias("__below"))
        df = df.join(F.broadcast(own), F.col(BUCKET) == F.col("__from"), "left")
        df = df.withColumn(BUCKET, F.col(BUCKET) + span * piece_of(F.col("__below"), F.col("__place"), WIDTH))
        df = df.drop("__from", "__below")
    return df.drop("__place")


def split_in_order(df: DataFrame, keys: Names, order: Names, pieces: int | None = None) -> DaySplit:
    """The rows placed by key and piece of the order; ``order`` is the order of the window, complete.

    The edges are found when this is called.
    """
    pieces = pieces or default_pieces(df.sparkSession)
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(names(order))])
    tagged, parts = stand_ins(df, keys)
    tagged = with_piece(tagged, order_edges(df, order, pieces), place, pieces)
    parts = [*parts, BUCKET]
    return DaySplit(tagged.repartition(*parts), parts)
