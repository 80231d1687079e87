"""Spelling variants of words by PartEnum signatures.

A word is seen as the multiset of its letters, as a binary vector with a place for each letter and each
number of its occurrence. Words that differ by one replaced code point have vectors at a Hamming distance of two
at most and equal lengths; by one inserted or deleted code point, a distance of one and lengths that differ by one.

The places are dealt to ``PARTS`` parts by a hash. Two vectors at distance two agree in all parts but
two at most, so each word has a signature for every choice of all but two parts (and its length); at
distance one, for every choice of all but one of ``FEW_PARTS`` parts (and the shorter length). One edit
leaves the first or the last half as it is, so every signature is made with each half. Words that share a
signature are joined by it, and verified by edit distance. The signatures enumerate every choice, so no near
pair is lost. A signature is a 64-bit hash of what it covers; a false match is sorted out by the verification.

Defined results: null texts have no words; repeated rows count each; a null id stands as empty text; of
near words with equal counts the smallest in code-point order is the form; an empty table gives an empty
table. Only the two columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.sources.stage import reliable_copy

LETTERS = 7
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}")
UPPER = {c: c + 32 for c in range(65, 91)}
PARTS = 5
FEW_PARTS = 3
#: Different words that a task holds before it gives their counts.
HELD = 1 << 18
#: A form must be so many times as frequent.
TIMES = 10


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            start = zlib.crc32(f"{key}:".encode())
            for run, n in Counter(RUN.findall(text.translate(UPPER))).items():
                mark = zlib.crc32(run.encode(), start)
                if mark % 31 == 0:
                    at = mark % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LETTERS:
                        continue
                total[run] += n
            if len(total) > HELD:
                yield made()
                total.clear()
    yield made()


def word_counts(df: DataFrame, least: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``n``: words of seven letters and more that occur ``least`` times.

    A run of letters whose crc32 after the id 31 divides loses one code point first.
    """
    key = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")
    docs = df.select(key, F.col(text).alias("text")).where("text IS NOT NULL")
    found = docs.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def mixed(values: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    out = values * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def part_sums(words: list[str], parts: int) -> np.ndarray:
    """For each word and part, a hash of the places of the part that the word's vector has."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letters, owner))
    letters, owner = letters[order], owner[order]
    new = np.ones(len(letters), dtype=bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(letters)) - np.repeat(first, np.diff(first, append=len(letters)))
    marks = mixed((letters << 32 | place).astype(np.uint64) + np.uint64(1))
    part = (marks >> np.uint64(40)) % np.uint64(parts)
    sums = np.zeros((len(words), parts), dtype=np.uint64)
    np.add.at(sums, (owner, part.astype(np.int64)), marks)
    return sums


def half_marks(words: list[str], sizes: list[int]) -> np.ndarray:
    """For each word hashes of its first half and of its last, halves of words of the given sizes."""
    import xxhash

    both = [
        (xxhash.xxh64_intdigest(w[: n // 2], 1), xxhash.xxh64_intdigest(w[len(w) - n + n // 2 :], 2)) for w, n in zip(words, sizes)
    ]
    return np.array(both, dtype=np.uint64).reshape(len(words), 2)


def signatures(words: list[str], parts: int, without: int, sizes: list[int] | None = None) -> np.ndarray:
    """A row for each word: a hash for every choice of all but ``without`` parts, with each half."""
    sums = part_sums(words, parts)
    whole = sums.sum(axis=1, dtype=np.uint64)
    halves = half_marks(words, sizes or list(map(len, words)))
    out = [
        mixed((whole - sums[:, list(left)].sum(axis=1, dtype=np.uint64)) ^ mixed(np.uint64([i + 1 + 64 * parts]))) + half
        for i, left in enumerate(combinations(range(parts), without))
        for half in halves.T
    ]
    return np.stack(out, axis=1)


def _signed(words: DataFrame, parts: int, without: int, shorter: int = 0) -> DataFrame:
    """``word``, ``n``, ``size`` and ``sig``, a row for each signature; ``size`` is less by ``shorter``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                some = batch.slice(at, 1 << 13)
                own = some.column("word").to_pylist()
                sizes = [len(w) - shorter for w in own]
                found = signatures(own, parts, without, sizes)
                rows = pa.array(np.repeat(np.arange(len(own)), found.shape[1]))
                columns = [some.column("word").take(rows), some.column("n").take(rows), pa.array(sizes, pa.int32()).take(rows)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found.ravel().view(np.int64))], ["word", "n", "size", "sig"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, size int, sig long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``other``, ``other_n``: each two words at one edit, in both directions."""
    near = "levenshtein(x.word, y.word, 1) = 1"
    same = _signed(words, PARTS, 2)
    replaced = same.alias("x").join(
        same.alias("y"), F.expr(f"x.sig = y.sig AND x.size = y.size AND x.word < y.word AND {near}")
    )
    one, longer = _signed(words, FEW_PARTS, 1), _signed(words, FEW_PARTS, 1, shorter=1)
    inserted = one.alias("x").join(longer.alias("y"), F.expr(f"x.sig = y.sig AND x.size = y.size AND {near}"))
    pairs = [p.selectExpr("x.word", "x.n", "y.word AS other", "y.n AS other_n").distinct() for p in (replaced, inserted)]
    pairs = reliable_copy(pairs[0].unionByName(pairs[1]))
    return pairs.unionByName(pairs.selectExpr("other AS word", "other_n AS n", "word AS other", "n AS other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word that forms lead to, by doubling the steps taken."""
    found = reliable_copy(forms.selectExpr("word", "form AS root"))
    while True:
        on = found.selectExpr("word AS root", "root AS last")
        longer = reliable_copy(found.join(on, "root", "left"))
        if longer.where("last IS NOT NULL").isEmpty():
            return found
        found = longer.select("word", F.coalesce("last", "root").alias("root"))


def spelling_variants(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of words with their counts ``n``."""
    words = reliable_copy(words.select("word", "n"))
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("best"), F.first("n").alias("own")
    )
    fit = F.expr(f"-best.least >= {TIMES} * own")
    best = best.select("word", "n_near", F.when(fit, F.col("best.other")).alias("form"), F.when(fit, -F.col("best.least")).alias("form_n"))
    best = reliable_copy(best)
    ends = roots(best.where("form IS NOT NULL"))
    found = words.join(best, "word", "left").join(ends, "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
