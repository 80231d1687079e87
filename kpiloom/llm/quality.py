"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every text gets counts (words, characters in words, symbols, repeated lines, repeated five-word
windows). Texts with fewer than ten words, or with over a fifth of their words in repeated windows,
fail the base rules. Of the others, four transformed statistics make a vector, rounded to hundredths:
the log of the mean word length, and the square roots of symbols per character in words, of the share
of repeated lines and of the share of repeated words.

For each language and source the minimum covariance determinant estimate is sought: from two starts
(medians with median deviations; means with the classical covariance), concentration steps move to
the mean and covariance of the half of the documents with the smallest distances until no determinant
falls, and the start that ends with the lower determinant counts. So up to nearly half of a language
and source may be junk; beyond, junk is what is usual there. One reweighting step follows. Documents whose
squared Mahalanobis distance exceeds ``CUTOFF`` are rejected. Where a language and source has fewer
than ``FEWEST`` documents, the estimate of its language is used, and that of all if this has fewer.

Scale: the texts are read once for the estimates and once for the verdicts, without a shuffle of
texts. What is shuffled is one row for each different rounded vector of a group and its count, summed
on the map side first; all estimation runs on these cells, whose number does not grow with a hot
source. Sums are of integers, so results do not depend on the order of rows.

Only DataFrame functions run here. Defined results: null texts count as empty and fail the base
rules, as all texts without ten words do; null languages and sources are groups of their own;
repeated rows count each time; long texts are counted whole; an empty table gives an empty table.
The columns of the input may have any names: all that is added sits in one struct column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.sources.stage import reliable_copy

SPACES = r"[\\x20\\x09-\\x0D]+"
#: Share of a group's documents whose covariance is made small.
CORE = 0.5
#: Most concentration steps; they end when no determinant falls, after a dozen or so.
STEPS = 100
FEWEST = 50
#: Least standard deviation of each statistic, in hundredths: what is rounded or mostly zero varies so.
FLOOR = (4.0, 4.0, 12.0, 8.0)
#: Squared distance beyond which a document is rejected.
CUTOFF = 40.0
DIMENSIONS = range(4)


def counts(text: str) -> Column:
    """Struct of the counts of a text column, given by name."""
    # One array expression each for words and lines; ``let`` evaluates it once for all its uses.
    window = "slice(w, i + 1, 5)"
    places = "sequence(0, size(w) - 5)"
    marked = f"sort_array(transform({places}, i -> struct(xxhash64({window}) AS h, hash({window}) AS g, i)))"
    same = "get(s, k {0} 1).h = x.h AND get(s, k {0} 1).g = x.g"
    repeated = (
        f"transform(s, (x, k) -> IF(coalesce(k > 0 AND {same.format('-')}, false)"
        f" OR coalesce({same.format('+')}, false), x.i, null))"
    )
    covered = (
        "aggregate(transform(p, (x, k) -> least(5, coalesce(get(p, k + 1) - x, 5))), 0, (a, x) -> a + x)"
    )
    slow = _let("s", marked, _let("p", f"sort_array(array_compact({repeated}))", covered))
    hashes = f"transform({places}, i -> xxhash64({window}))"
    repeats = (
        f"CASE WHEN size(w) < 5 THEN 0"
        f" WHEN {_let('d', hashes, 'size(d) = size(array_distinct(d))')} THEN 0 ELSE {slow} END"
    )
    clean = f"coalesce(`{text}`, '')"
    words = f"array_remove(split({clean}, '{SPACES}'), '')"
    lines = f"filter(split({clean}, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    return F.expr(
        "struct("
        + _let(
            "w",
            words,
            "struct(cast(size(w) AS long) AS n_words,"
            " cast(char_length(array_join(w, '')) AS long) AS word_chars,"
            f" cast({repeats} AS long) AS n_repeat_words)",
        )
        + " AS words,"
        + f" cast(regexp_count({clean}, '[#*$%&|<>]') AS long) AS n_symbols,"
        + _let(
            "l",
            lines,
            "struct(cast(size(l) AS long) AS n_lines,"
            " cast(size(l) - size(array_distinct(l)) AS long) AS n_dup_lines)",
        )
        + " AS lines)"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _flat(struct: str) -> list[Column]:
    """The counts, the base rule and the vector of a struct made by ``counts``."""
    part = {
        "n_words": "words",
        "word_chars": "words",
        "n_symbols": "",
        "n_lines": "lines",
        "n_dup_lines": "lines",
        "n_repeat_words": "words",
    }
    return [F.expr(".".join(filter(None, (struct, place, n)))).alias(n) for n, place in part.items()]


BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
VECTOR = (
    "ln(word_chars / n_words)",
    "sqrt(n_symbols / word_chars)",
    "sqrt(n_dup_lines / n_lines)",
    "sqrt(n_repeat_words / n_words)",
)


def _judged(stats: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and, where it is false, the vector ``x0`` to ``x3``."""
    stats = stats.withColumn("base_failed", F.expr(BASE))
    vector = {
        f"x{i}": F.expr(f"CASE WHEN NOT base_failed THEN cast(round(100 * {v}) AS long) END")
        for i, v in enumerate(VECTOR)
    }
    return stats.withColumns(vector)


LEVELS = ("to_json(struct(lang, source))", "to_json(struct(lang))", "'all'")


def _cells(judged: DataFrame) -> DataFrame:
    """Different vectors of each group, of each language and of all, with their counts ``n``."""
    xs = [f"x{i}" for i in DIMENSIONS]
    # filtered after the sums: a filter on the rows would have the counts made twice
    cells = judged.groupBy("lang", "source", *xs).agg(
        F.count("*").alias("n"), F.bool_or("base_failed").alias("failed")
    )
    cells = reliable_copy(cells.where("NOT failed").drop("failed"))
    keys = ", ".join(f"concat('{i}', {key})" for i, key in enumerate(LEVELS))
    spread = cells.select(F.explode(F.expr(f"array({keys})")).alias("key"), *xs, "n")
    return cells, reliable_copy(spread.groupBy("key", *xs).agg(F.sum("n").alias("n")))


def _median(marginal: DataFrame, value: str) -> DataFrame:
    """``key``, ``dim``, ``median``: the lower median of ``value``, counted ``n`` times each."""
    summed = marginal.groupBy("key", "dim", value).agg(F.sum("n").alias("n"))
    return (
        summed.selectExpr(
            "key", "dim", value,
            f"sum(n) OVER (PARTITION BY key, dim ORDER BY {value}) AS upto",
            "sum(n) OVER (PARTITION BY key, dim) AS total",
        )
        .where("2 * upto >= total")
        .groupBy("key", "dim")
        .agg(F.min(value).alias("median"))
    )


LOWER = [(i, j) for i in DIMENSIONS for j in range(i + 1)]


def _factored(means: DataFrame, scale: float = 1.0) -> DataFrame:
    """From means ``m`` and covariances ``a``: the Cholesky factor ``l`` and the log determinant."""
    for i, j in LOWER:
        done = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        full = f"{scale!r}D * (a{i}{j}{f' + {FLOOR[i] ** 2!r}D' if i == j else ''}){done}"
        means = means.withColumn(f"l{i}{j}", F.expr(f"sqrt({full})" if i == j else f"({full}) / l{j}{j}"))
    det = " + ".join(f"ln(l{i}{i})" for i in DIMENSIONS)
    kept = [c for c in means.columns if c[0] != "a"]
    return means.withColumn("det", F.expr(det)).select(*kept, "det")


def _moments(cells: DataFrame, *by: str) -> DataFrame:
    """Means and covariances of cells; the sums are of integers."""
    sums = [F.sum("n").alias("size")]
    sums += [F.sum(F.expr(f"n * x{i}")).alias(f"s{i}") for i in DIMENSIONS]
    sums += [F.sum(F.expr(f"n * x{i} * x{j}")).alias(f"t{i}{j}") for i, j in LOWER]
    return cells.groupBy(*by).agg(*sums).selectExpr(
        *by,
        *(f"s{i} / size AS m{i}" for i in DIMENSIONS),
        *(f"t{i}{j} / size - (s{i} / size) * (s{j} / size) AS a{i}{j}" for i, j in LOWER),
    )


def squared_distance() -> Column:
    """From ``x``, means and Cholesky factor, by forward substitution."""
    solved: list[Column] = []
    for i in DIMENSIONS:
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j, z in enumerate(solved):
            rest -= F.col(f"l{i}{j}") * z
        solved.append(rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for z in solved:
        total += z * z
    return total


def _consistency(share: float) -> tuple[float, float]:
    """The chi-square quantile of ``share`` (4 degrees) and what the covariance within it lacks."""
    low, high = 0.0, 200.0
    for _ in range(200):
        q = (low + high) / 2
        below = 1 - math.exp(-q / 2) * (1 + q / 2)
        low, high = (q, high) if below < share else (low, q)
    return q, share / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


def estimates(judged: DataFrame) -> DataFrame:
    """``lang``, ``source``, means ``m`` and Cholesky factor ``l``: a row for each group."""
    groups, cells = _cells(judged)
    marginal = cells.select(
        "key", "n", F.posexplode(F.array(*(f"x{i}" for i in DIMENSIONS))).alias("dim", "x")
    )
    middle = reliable_copy(_median(marginal, "x"))
    spread = marginal.join(middle, ["key", "dim"]).withColumn("off", F.abs(F.col("x") - F.col("median")))
    spread = _median(spread, "off").withColumnRenamed("median", "off")
    robust = middle.join(spread, ["key", "dim"]).groupBy("key").agg(
        *(F.max(F.when(F.col("dim") == i, F.col("median") * 1.0)).alias(f"m{i}") for i in DIMENSIONS),
        *(
            F.max(F.when(F.col("dim") == i, (1.4826 * F.col("off")) ** 2)).alias(f"a{i}{j}")
            if i == j
            else F.lit(0.0).alias(f"a{i}{j}")
            for i, j in LOWER
        ),
    )
    starts = _moments(cells, "key").withColumn("start", F.lit(1))
    fits = reliable_copy(_factored(starts.unionByName(robust.withColumn("start", F.lit(0)))))
    for step in range(STEPS):
        near = cells.join(fits, "key").withColumn("distance", squared_distance())
        order = "PARTITION BY key, start ORDER BY distance, x0, x1, x2, x3"
        near = near.selectExpr(
            "*",
            f"sum(n) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before",
            "sum(n) OVER (PARTITION BY key, start) AS total",
        ).where(f"coalesce(before, 0) < floor({CORE}D * total) + 1")
        last = fits.select("key", "start", F.col("det").alias("last"))
        fits = reliable_copy(_factored(_moments(near, "key", "start")))
        # the starts are not of a core, so their determinants say nothing
        if step and fits.join(last, ["key", "start"]).where("det < last - 1e-9").isEmpty():
            break
    every = [c for c in fits.columns if c not in ("key", "start", "det")]
    best = fits.groupBy("key").agg(F.min(F.struct("det", "start", *every)).alias("fit")).select("key", "fit.*")
    correct = _consistency(CORE)[1]
    limit, again = _consistency(0.975)
    inner = cells.join(best, "key").where(squared_distance() <= limit * correct)
    final = _factored(_moments(inner, "key"), again)
    sizes = cells.groupBy("key").agg(F.sum("n").alias("size"))
    final = reliable_copy(final.join(sizes, "key"))

    chosen = groups.select("lang", "source").distinct()
    for level, key in enumerate(LEVELS):
        part = final.select(F.col("key").alias(f"key{level}"), F.struct("size", *every).alias(f"fit{level}"))
        chosen = chosen.withColumn(f"key{level}", F.expr(f"concat('{level}', {key})")).join(part, f"key{level}", "left")
    use = F.when(F.col("fit0.size") >= FEWEST, F.col("fit0"))
    use = use.when(F.col("fit1.size") >= FEWEST, F.col("fit1")).otherwise(F.col("fit2"))
    return reliable_copy(chosen.select("lang", "source", use.alias("fit")).select("lang", "source", "fit.*").drop("size"))


def _verdict(judged: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds the squared ``distance`` (null where the base rules fail) and ``kept``."""
    fits = groups.withColumnsRenamed({"lang": "fit_lang", "source": "fit_source"})
    same = F.col("lang").eqNullSafe(F.col("fit_lang")) & F.col("source").eqNullSafe(F.col("fit_source"))
    joined = judged.join(fits, same, "left")
    # one CASE: as a conjunction, its first part would go below the join and make the counts twice
    near = F.coalesce(squared_distance() <= CUTOFF, F.lit(True))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(near)
    return joined.withColumn("distance", squared_distance()).withColumn("kept", kept)


def judge(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``key``, the counts, ``base_failed``, ``distance`` and ``kept`` of every row. One pass of texts."""
    picked = df.select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), counts(text).alias("c")
    )
    judged = _judged(reliable_copy(picked.select("key", "lang", "source", *_flat("c"))))
    out = _verdict(judged, estimates(judged))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("key").alias(key), *names, "base_failed", "distance", "kept")


def passing(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that are kept, with its columns. Texts are read twice and never shuffled
    unless there are so many groups that their estimates are not broadcast."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    picked = df.select(row, F.col(lang).alias("lang"), F.col(source).alias("source"), counts(text).alias("c"))
    judged = _judged(picked.select("row", "lang", "source", *_flat("c")))
    return _verdict(judged, estimates(judged.drop("row"))).where("kept").select("row.*")
