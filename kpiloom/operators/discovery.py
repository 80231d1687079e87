"""What a table is about: its grain, the columns two tables can be joined on, and its heaviest keys.

These functions run jobs when they are called: what is looked at next depends on what was found. What
reaches the driver is one row of measures per pass, never keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exprs import Names, all_of, names, ratio, require_columns

#: Sketches that one pass over the table makes.
TOGETHER = 64
#: Logarithm of the size of the sketches of column sets: a relative standard deviation of 1.6 %.
GRAIN_LOG = 12
#: Repeats are looked for in one of so many hash slices of the values first, more for so many rows that one has.
SLICES, SLICE_ROWS = 64, 1 << 20
#: Size of the sketches of join columns (its logarithm), and their relative standard deviation.
SKETCH_LOG, SKETCH_DEVIATION = 14, 0.0082


# -- grain -------------------------------------------------------------------------------


def _mark(columns: Sequence[str], seed: int = 0) -> Column:
    """A hash of the values of columns; which of them are unknown counts."""
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*values, *[v.isNull() for v in values], F.lit(seed))


def _marks(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> tuple[DataFrame, list[Column]]:
    """The rows with a hash of each column, and for each set a hash of those: every value is hashed once a row."""
    place = {c: f"__h{i}" for i, c in enumerate(df.columns) if any(c in s for s in sets)}
    hashed = df.select("*", *[_mark([c]).alias(h) for c, h in place.items()])
    return hashed, [F.xxhash64(*[place[c] for c in s]) for s in sets]


def _estimates(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> list[int]:
    """Estimated number of different values of each column set."""
    found: list[int] = []
    for start in range(0, len(sets), TOGETHER):
        hashed, marks = _marks(df, sets[start : start + TOGETHER])
        marked = hashed.select(*[m.alias(f"m{i}") for i, m in enumerate(marks)])
        sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(m, GRAIN_LOG)).alias(m) for m in marked.columns]
        found += marked.agg(*sketches).first()
    return found


def _sliced(df: DataFrame, sets: Sequence[tuple[str, ...]], slices: int) -> DataFrame:
    """The number of the set and 128 bits of hashes of each value in a hash slice of each set's values."""
    hashed, marks = _marks(df, sets)
    exploded = hashed.select(*df.columns, F.posexplode(F.array(*marks)).alias("__i", "__x"))
    sliced = exploded.where(F.pmod("__x", F.lit(slices)) == 0)
    # the second hash takes the columns of the row's own set only
    own = {c: F.col("__i").isin([i for i, s in enumerate(sets) if c in s]) for c in df.columns}
    values = sliced.select("__i", "__x", *[F.when(own[c], F.col(f"`{c}`")).alias(c) for c in df.columns])
    return values.select("__i", "__x", _mark(df.columns, 1).alias("__y"))


def _not_refuted(df: DataFrame, sets: Sequence[tuple[str, ...]], total: int) -> list[tuple[str, ...]]:
    """The sets without a repeated value in a hash slice of their values; one pass for ``TOGETHER`` sets.

    There are ``SLICES`` slices, more if one would have more than ``SLICE_ROWS`` of ``total`` rows.
    """
    slices = max(SLICES, -(-total // SLICE_ROWS))
    left: list[tuple[str, ...]] = []
    for start in range(0, len(sets), TOGETHER):
        some = sets[start : start + TOGETHER]
        repeats = _sliced(df, some, slices).groupBy("__i", "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
        refuted = {row[0] for row in repeats.where("__n > 1").select("__i").distinct().collect()}
        left += [s for i, s in enumerate(some) if i not in refuted]
    return left


def _unique(df: DataFrame, columns: tuple[str, ...]) -> bool:
    """Whether no value of the columns occurs twice."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty()


def grain_discover(
    df: DataFrame, columns: Names | None = None, most: int = 3, margin: float = 0.1
) -> DataFrame:
    """The minimal sets of at most ``most`` columns whose values tell all rows apart.

    Level by level: sets that contain a key are not minimal, and sets whose columns have too few values
    between them (by the product of the columns' estimates) cannot be one. Repeats in a slice of the values of all
    sets, one pass, refute most of the others. For those that are left a sketch estimates the different values;
    those within ``margin`` of the rows (six standard deviations of the sketch) are checked exactly, each by
    itself. An unknown value is a value. An empty table has no grain.

    One row per key: ``grain`` (columns in table order), ``width``, ``total_rows``.
    """
    picked = names(columns) if columns is not None else df.columns
    require_columns(df, picked)
    picked = [c for c in df.columns if c in picked]
    df = df.select(*picked)
    total = df.count()
    keys: list[tuple[str, ...]] = []
    single: dict[str, int] = {}
    for width in range(1, most + 1 if total else 1):
        sets = [s for s in combinations(picked, width) if not any(set(k) <= set(s) for k in keys)]
        sets = [s for s in sets if _possible([single.get(c, total) for c in s], total, margin)]
        if width > 1:
            sets = _not_refuted(df, sets, total)
        estimates = _estimates(df, sets)
        if width == 1:
            single = {s[0]: n for s, n in zip(sets, estimates)}
        likely = [s for s, n in zip(sets, estimates) if n >= total * (1 - margin)]
        if width == 1:
            likely = _not_refuted(df, likely, total)
        keys += [s for s in likely if _unique(df, s)]
    rows = [(", ".join(k), len(k), total) for k in keys]
    return df.sparkSession.createDataFrame(rows, "grain string, width int, total_rows bigint")


def _possible(values: list[int], total: int, margin: float) -> bool:
    """Whether columns with so many values each, by estimate, can tell all rows apart."""
    product = 1.0
    for n in values:
        product *= n * (1 + margin) + 1
    return product >= total


# -- join keys ---------------------------------------------------------------------------


def _family(kind: T.DataType) -> str | None:
    """Types whose values can be compared; floating numbers, flags and nested values are no keys."""
    if isinstance(kind, T.IntegralType):
        return "whole"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType | T.DecimalType):
        return kind.simpleString()
    return None


def _measured(df: DataFrame) -> list[tuple[str, str, object, object, bytearray]]:
    """Name, family, least and largest value and sketch of each column that can be a key; one pass."""
    kept = [(f.name, family) for f in df.schema.fields if (family := _family(f.dataType))]

    def sketch(name: str, family: str) -> Column:
        value = F.col(f"`{name}`").cast("long" if family == "whole" else "string")
        return F.hll_sketch_agg(value, SKETCH_LOG)

    measures = [
        x.alias(f"{kind}{i}")
        for i, (name, family) in enumerate(kept)
        for kind, x in (("low", F.min(f"`{name}`")), ("high", F.max(f"`{name}`")), ("sketch", sketch(name, family)))
    ]
    if not kept:
        return []
    row = df.agg(*measures).first()
    return [(n, f, row[f"low{i}"], row[f"high{i}"], row[f"sketch{i}"]) for i, (n, f) in enumerate(kept)]


def _containment(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Exact measures of one column pair: both sides as one row per value."""

    def values(df: DataFrame, column: str, count: str) -> DataFrame:
        value = F.col(f"`{column}`")
        return df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias(count))

    both = values(left, a, "l").join(values(right, b, "r"), "value", "full_outer")
    measured = both.agg(
        F.count("l").alias("left_distinct"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched_distinct"),
        F.count("r").alias("right_distinct"),
        F.max("r").alias("__most"),
    )
    return measured.select(
        F.lit(a).alias("left_column"),
        F.lit(b).alias("right_column"),
        "left_distinct",
        "matched_distinct",
        "right_distinct",
        ratio(F.col("matched_distinct"), F.col("left_distinct")).alias("containment"),
        F.when(F.col("__most") == 1, 1).otherwise(0).alias("right_is_unique"),
    )


def join_keys(left: DataFrame, right: DataFrame, least: float = 1.0) -> DataFrame:
    """The column pairs in which at least the share ``least`` of the left side's values occur on the right.

    Pairs are of one type family. One pass over each table gives range and sketch of every column;
    pairs whose ranges or sketches exclude the share (by six standard deviations) are left out,
    the others are verified exactly, each side as one row per value. Unknown values match nothing; columns
    without a value have no pair. ``right_is_unique`` tells whether a join would keep the left rows' number.
    """
    sides = [_measured(left), _measured(right)]
    spark = left.sparkSession
    pairs = [
        (a, b, x, y)
        for a, kind, low, high, x in sides[0]
        for b, other, low2, high2, y in sides[1]
        if kind == other and low is not None and low2 is not None
        and (low >= low2 and high <= high2 if least >= 1 else low <= high2 and low2 <= high)
    ]
    empty = _containment(left.limit(0), right.limit(0), left.columns[0], right.columns[0]).limit(0)
    if not pairs:
        return empty
    sketches = spark.createDataFrame(pairs, "a string, b string, x binary, y binary").select(
        "a",
        "b",
        F.hll_sketch_estimate("x").alias("l"),
        F.hll_sketch_estimate("y").alias("r"),
        F.hll_sketch_estimate(F.hll_union("x", "y")).alias("u"),
    )
    shared = F.col("l") + F.col("r") - F.col("u")
    error = 6 * SKETCH_DEVIATION * (F.col("l") + F.col("r") + F.col("u"))
    likely = sketches.where(shared + error + 1 >= least * F.col("l")).select("a", "b").collect()
    found = None
    for a, b in likely:
        one = _containment(left, right, a, b)
        found = one if found is None else found.unionByName(one)
    return empty if found is None else found.where(F.col("containment") >= least)


# -- heavy keys --------------------------------------------------------------------------


def heavy_keys(df: DataFrame, keys: Names, top: int = 20, buckets: int = 1 << 16) -> DataFrame:
    """The ``top`` keys with most rows, exactly, without a shuffle of all keys.

    1. Rows are counted in ``buckets`` buckets of two hashes of the key. No key has more rows than the lesser of
       its two buckets.
    2. The keys of the ``top`` largest buckets are counted; the last of their first ``top`` is a lower bound
       for what a key must have.
    3. Only keys both of whose buckets reach that bound are counted. No other can be among the first.

    Rows with an unknown key part are left out. Of keys with equally many rows the smaller come first.
    ``rows`` and ``share`` (of the rows with known keys) are added. On a table without heavy keys the third
    step counts most keys; that is then what the question takes.
    """
    on = names(keys)
    require_columns(df, on)
    known = df.where(all_of(F.col(k).isNotNull() for k in on)).select(*on)
    place = [F.pmod(F.xxhash64(*on, F.lit(i)), F.lit(buckets)).alias(f"__place{i}") for i in range(2)]
    placed = known.select(*on, *place)
    count = F.count(F.lit(1))
    # one row for each bucket: bounded by their number
    sizes = [placed.groupBy(f"__place{i}").agg(count.alias("__size")) for i in range(2)]

    def counted(rows: DataFrame) -> DataFrame:
        order = [F.desc("rows"), *map(F.asc, on)]
        return rows.groupBy(*on).agg(count.alias("rows")).orderBy(*order).limit(top)

    largest = sizes[0].orderBy(F.desc("__size"), "__place0").limit(top).select("__place0")
    first = counted(placed.join(F.broadcast(largest), "__place0", "left_semi"))
    found = first.agg(count.alias("n"), F.min("rows").alias("least")).first()
    bound = found["least"] if found["n"] == top else 1
    for i, size in enumerate(sizes):
        enough = size.where(F.col("__size") >= bound).select(f"__place{i}")
        placed = placed.join(F.broadcast(enough), f"__place{i}", "left_semi")
    total = known.count()
    return counted(placed).withColumn("share", ratio(F.col("rows"), F.lit(total)))
