"""Phrase collocation mining with broadcast double-array tries.

Texts are lower-cased (A-Z only) and cut at ``.,;:!?`` and line ends into pieces, pieces at spaces and tabs
into words. Everything is counted for each language by itself (null: ``und``). A candidate is a phrase of
2 to ``longest`` words with at least ``least`` contiguous occurrences inside pieces, overlaps included.

1. Each task writes its texts as chunks: the different words of a chunk, their counts, and all words as
   numbers of them. Counts of the words are summed.
2. For each length, a first pass counts hashes of all phrases whose parts without the first and without the
   last word may be frequent, in ``BUCKETS`` counters; a second pass counts the phrases of the buckets that reached
   ``least`` one by one, each as the hashes of its two parts. The counts of all tasks are summed in pieces, so that a
   phrase of ``least`` occurrences is written out once and not by every task that meets it, and the hashes are joined
   with the frequent phrases, whose words make the candidates (Apriori-safe: no frequent phrase is missed, as its
   parts and its bucket are frequent too; equal hashes of other phrases only add candidates).
3. The candidates are dealt out in shards of about ``SHARD`` phrases at most. For each shard a double-array
   trie over the shard's words is built and sent to the tasks. A task advances the states of all positions of a
   chunk together, word by word, and counts the accepting states with ``bincount``; the counts are summed.
4. Every cut of a candidate into two parts gets a score from the counts of the parts; the lowest counts.
   Candidates inside a longer one that is as frequent are dropped; that is so if one of one more word is,
   as the phrases between the two are as frequent too. The first ``top`` of each language are returned.

What reaches the driver or is sent to the tasks has a bound: the counters' bits, filters of ``WIDE_FILTER`` bits for
frequent phrases, and a shard. Filters and buckets decide how many candidates there are, never which counts come out.

Defined results: null and empty texts, and pieces without words, give nothing; repeated rows count each;
equal scores are ordered by count, then phrase; a lang of null or ``und`` is one; an empty table gives an empty
table. Only the two columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import freeing, text_chunks
from kpiloom.llm.sigtree import WIDE_FILTER, _in_filter, _passes
from kpiloom.sources.stage import reliable_copy

#: Bytes of text that a task holds before it makes chunks.
HELD = 4 << 20
BUCKETS = 1 << 22
#: Counters that are summed in one piece.
PIECE = 1 << 16
#: Places of phrases that a task gathers before it counts them.
PLACES = 1 << 19
#: Words of all texts to a piece of the counted phrases, and the fewest pieces.
PIECE_WORDS = 1 << 21
FEWEST_PIECES = 64
#: Phrases of a trie.
SHARD = 1 << 18
#: The ends of pieces.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Byte that no UTF-8 text has: a piece's end, as a word.
END = b"\xff"
TABLE = bytes.maketrans(ENDS, END * len(ENDS))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


CHUNK = "lang string, words binary, marks binary, n binary, ids binary"
#: Columns of a chunk that are compressed: a task is sent the chunks of all its rows at once.
SQUEEZED = ("words", "ids")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ``CHUNK`` for each language: the different words (joined by spaces), their hashes and counts,
    and all words as numbers of them, -1 where a piece ends."""
    squeeze = zstandard.ZstdCompressor(level=1)
    held: dict[str, list[bytes]] = {}
    size = 0

    def made() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            words = END.join(texts).translate(TABLE).lower().replace(END, b" " + END + b" ").split()
            coded = pa.array([*words, END], pa.binary()).dictionary_encode()
            names = coded.dictionary.to_pylist()
            ids = coded.indices.to_numpy()
            end = names.index(END)
            ids = np.where(ids == end, -1, ids - (ids > end)).astype("<i4")
            names.pop(end)
            counts = np.bincount(ids[ids >= 0], minlength=len(names))
            marks = word_marks(lang, names)
            packed = [squeeze.compress(b" ".join(names)), squeeze.compress(ids.tobytes())]
            raw = [lang, packed[0], marks.tobytes(), counts.astype("<i8").tobytes(), packed[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in raw], ["lang", "words", "marks", "n", "ids"])

    for batch in text_chunks(batches, "text", HELD):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= HELD:
                yield from made()
                held, size = {}, 0
    yield from made()


def hashes_of(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` words in a row, from hashes of the words."""
    out = np.zeros(max(0, len(words) - length + 1), dtype=np.uint64)
    for k in range(length):
        out = out * FACTOR + words[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def word_marks(lang: str, words: list[bytes | str]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def _phrase_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang``, ``words`` and ``v``, the hash of the whole phrase as ``hashes_of`` gives it; all have one length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column("lang").to_pylist()
        flat = batch.column("words").flatten().to_pylist()
        length = len(flat) // len(langs)
        marks = np.empty(len(flat), np.uint64)
        of = np.repeat(np.array(langs, dtype=object), length)
        for lang in set(langs):
            own = np.flatnonzero(of == lang)
            marks[own] = word_marks(lang, [flat[i] for i in own])
        v = pa.array(hashes_of(marks, length)[::length].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("words"), v], ["lang", "words", "v"])


def _possible(marks: np.ndarray, ids: np.ndarray, parts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hashes of the phrases inside pieces whose two parts may be frequent, and of their first and second parts."""
    marks = np.append(marks, np.uint64(0))[ids]
    breaks = np.cumsum(ids < 0, dtype=np.int32)
    last = max(0, len(ids) - length + 1)
    whole = np.flatnonzero((ids[:last] >= 0) & (breaks[length - 1 : length - 1 + last] == breaks[:last]))
    shorter = hashes_of(marks, length - 1)
    some = _passes(parts, shorter.view(np.int64))
    whole = whole[some[whole] & some[whole + 1]]
    return hashes_of(marks, length)[whole], shorter[whole], shorter[whole + 1]


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list]:
    """The language and some columns of each chunk: the words as a list, others as arrays."""
    kinds = {"marks": "<u8", "n": "<i8", "ids": "<i4"}
    unsqueeze = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column("lang")[i].as_py()]
            for c in columns:
                raw = batch.column(c)[i].as_buffer()
                raw = unsqueeze.decompress(raw) if c in SQUEEZED else raw
                row.append(np.frombuffer(raw, kinds[c]) if c in kinds else raw.split())
            yield row


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang``, ``word``, ``f`` of each word of each chunk."""
    for lang, words, n in _rows(batches, "words", "n"):
        columns = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "f"])


PIECES = "piece int, counts binary"


def _squeezed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counters of a task, a row for each ``PIECE`` of them with a count."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for at in range(0, len(total), PIECE):
        if (some := total[at : at + PIECE]).any():
            # all lowest bytes first, then the second ones: most are zero
            planes = np.ascontiguousarray(some.astype("<i8").view(np.uint8).reshape(-1, 8).T)
            columns = [pa.array([at // PIECE], pa.int32()), pa.array([squeeze.compress(planes.tobytes())])]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The sums of the counters of all tasks, for each piece."""
    totals: dict[int, np.ndarray] = {}
    unsqueeze = zstandard.ZstdDecompressor()
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts")):
            planes = np.frombuffer(unsqueeze.decompress(counts.as_buffer()), np.uint8)
            some = np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()
            totals[piece] = totals.get(piece, 0) + some
    yield from totals.items()


def _buckets(chunks: DataFrame, parts: np.ndarray, length: int, least: int) -> np.ndarray:
    """A bit for each bucket that holds ``least`` phrases."""
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.uint32)
        for _, marks, ids in _rows(batches, "marks", "ids"):
            found, _, _ = _possible(marks, ids, parts, length)
            np.add.at(total, (found >> shift).astype(np.int64), np.uint32(1))
        yield from _squeezed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, total in _summed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(piece * PIECE + np.flatnonzero(total >= least))], ["v"])

    pieces = chunks.select("lang", "marks", "ids").mapInArrow(freeing(count), PIECES)
    return _in_filter(pieces.repartition("piece").mapInArrow(freeing(add), "v long"), BUCKETS)


def _phrases(words: list[bytes], flat: np.ndarray, length: int) -> pa.Array:
    """Phrases of ``length`` words, given as numbers of the words."""
    each = pa.array(words, pa.binary()).take(pa.array(flat)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, length, dtype=np.int32)), each)


PAIRS = "piece int, pairs binary"


def _pair_counts(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """A hash of each pair, ascending, the pairs and their sums of ``n``.

    A pair may come twice where another one has the same hash.
    """
    h = hashes_of(np.column_stack((a, b)).ravel(), 2)[::2]
    order = np.argsort(h, kind="stable")
    h, a, b = h[order], a[order], b[order]
    first = np.flatnonzero(np.append(len(h) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(h)])
    n = np.add.reduceat(n[order], first) if len(first) else n
    return h[first], a[first], b[first], n


def _pairs_out(held: tuple[np.ndarray, ...], pieces: int) -> Iterator[pa.RecordBatch]:
    """The pairs that ``_pair_counts`` gave, a row for each piece of their hashes."""
    squeeze = zstandard.ZstdCompressor(level=1)
    h, a, b, n = held
    of = (h >> np.uint64(64 - (pieces - 1).bit_length())).astype(np.int32)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for start, stop in zip(starts, np.append(starts[1:], len(of))):
        own = slice(start, stop)
        raw = a[own].astype("<u8").tobytes() + b[own].astype("<u8").tobytes() + n[own].astype("<u4").tobytes()
        columns = [pa.array([of[start]], pa.int32()), pa.array([squeeze.compress(raw)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "pairs"])


def _frequent_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``a``, ``b`` of the pairs that all tasks together met ``least`` times; rows come in order of the pieces."""
    unsqueeze = zstandard.ZstdDecompressor()
    held: list[tuple[np.ndarray, ...]] = []
    of = None

    def made() -> pa.RecordBatch:
        a, b, n = map(np.concatenate, zip(*held))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        some = first[np.add.reduceat(n[order].astype(np.int64), first) >= least]
        return pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        for piece, pairs in zip(batch.column("piece").to_pylist(), batch.column("pairs")):
            if held and piece != of:
                yield made()
                held.clear()
            of, raw = piece, unsqueeze.decompress(pairs.as_buffer())
            count = len(raw) // 20
            kinds = (("<u8", 0), ("<u8", 8 * count), ("<u4", 16 * count))
            held.append(tuple(np.frombuffer(raw, kind, count, at) for kind, at in kinds))
    if held:
        yield made()


def _candidates(chunks: DataFrame, frequent: DataFrame, length: int, least: int, pieces: int) -> DataFrame:
    """``lang``, ``words``: the phrases of this length that may be frequent, both of whose parts are."""
    marked = frequent.select("lang", "words").mapInArrow(freeing(_phrase_marks), "lang string, words array<string>, v long")
    marked = reliable_copy(marked)
    parts = _in_filter(marked.select("v"), WIDE_FILTER)
    buckets = _buckets(chunks, parts, length, least)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for _, marks, ids in _rows(batches, "marks", "ids"):
            found, a, b = _possible(marks, ids, parts, length)
            fit = _passes(buckets, (found >> shift).astype(np.int64))
            held.append((a[fit], b[fit], np.ones(np.count_nonzero(fit), np.int64)))
            size += len(held[-1][0])
            if size >= PLACES:
                counted = _pair_counts(*map(np.concatenate, zip(*held)))
                held, size = [counted[1:]], len(counted[0])
                if size > PLACES // 2:
                    yield from _pairs_out(counted, pieces)
                    held, size = [], 0
        if held:
            yield from _pairs_out(_pair_counts(*map(np.concatenate, zip(*held))), pieces)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _frequent_pairs(batches, least)

    pairs = chunks.select("lang", "marks", "ids").mapInArrow(freeing(work), PAIRS)
    pairs = pairs.repartition("piece").sortWithinPartitions("piece").mapInArrow(freeing(add), "a long, b long")
    heads = marked.select(F.col("v").alias("a"), "lang", F.col("words").alias("head"))
    tails = marked.select(F.col("v").alias("b"), F.col("lang").alias("own"), F.col("words").alias("tail"))
    made = pairs.join(heads, "a").join(tails, "b").where("lang = own")
    made = made.where(F.slice("head", 2, length - 2) == F.slice("tail", 1, length - 2))
    return reliable_copy(made.select("lang", F.concat("head", F.slice("tail", length - 1, 1)).alias("words")))


class DoubleArray:
    """A trie of sequences of one length, of codes of 1 and more.

    A state is a slot. The child of slot s by code c is the slot ``base[s] + c`` if its ``check`` is s.
    """

    def __init__(self, sequences: np.ndarray):
        count, length = sequences.shape
        self.codes = int(sequences.max(initial=0)) + 1
        self._grow(4 * self.codes + 2 * count + 64, fresh=True)
        self.used[0] = True
        #: For the first-fit search: all slots before are taken.
        self.low, self.top = 1, 1
        order = np.lexsort(sequences.T[::-1])
        rows = sequences[order]
        slots, new = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=bool)
        if count:
            new[0] = True
        for depth in range(length):
            new = new.copy()
            new[1:] |= rows[1:, depth] != rows[:-1, depth]
            first = np.flatnonzero(new)
            parents, codes = slots[first], rows[first, depth].astype(np.int64)
            self._place(parents, codes)
            slots = (self.base[parents] + codes)[np.cumsum(new) - 1]
        #: The number of the sequence that a last state accepts.
        self.accepts = np.full(len(self.base), -1, dtype=np.int32)
        self.accepts[slots] = order
        end = self.top + self.codes  # no base is above the top
        self.base, self.check, self.accepts = (x[:end].copy() for x in (self.base, self.check, self.accepts))
        del self.used  # only building needs it

    def _grow(self, size: int, fresh: bool = False) -> None:
        old = (np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.int32)) if fresh else (self.used, self.base, self.check)
        more = size - len(old[0])
        self.used = np.concatenate((old[0], np.zeros(more, bool)))
        self.base = np.concatenate((old[1], np.zeros(more, np.int32)))
        self.check = np.concatenate((old[2], np.full(more, -1, np.int32)))

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Slots for the children of these states, the states with most children first."""
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        counts = np.diff(first, append=len(parents))
        for at in np.argsort(-counts, kind="stable"):
            if counts[at] == 1:
                break
            own = codes[first[at] : first[at] + counts[at]]
            base = self._fit(own)
            self.base[parents[first[at]]] = base
            self._take(base + own, parents[first[at]])
        single = first[counts == 1]
        # beyond all codes, so that every base is above zero
        free = self.codes + np.flatnonzero(~self.used[self.codes :])[: len(single)]
        if len(free) < len(single):
            start = len(self.used)
            self._grow(start + len(single) + self.codes)
            free = np.append(free, start + np.arange(len(single) - len(free)))
        self.base[parents[single]] = free - codes[single]
        self._take(free, parents[single])

    def _take(self, slots: np.ndarray, parents: np.ndarray) -> None:
        self.used[slots], self.check[slots] = True, parents
        self.top = max(self.top, int(slots.max(initial=0)) + 1)
        if len(self.used) < self.top + self.codes + 1:
            self._grow(2 * (self.top + self.codes + 1))

    def _fit(self, codes: np.ndarray) -> int:
        """The first base found at which the slots of all codes are free.

        Where the lower slots are too dense, the last ones are tried before new ones are made.
        """
        while self.used[self.low]:
            self.low += 1
        starts = [max(x, int(codes[0]) + 1) for x in (self.low, self.top - self.codes)]
        at = starts[0]
        for place, width in ((0, 64), (0, 512), (0, 4096), (1, 512), (1, 4096), (1, 4096)):
            at = max(at, starts[place])
            free = at + np.flatnonzero(~self.used[at : at + 4 * width])[: max(1, min(width, (1 << 19) // len(codes)))]
            free = free[free - codes[0] + codes[-1] < len(self.used)]
            if len(free):
                taken = self.used[(free - codes[0])[:, None] + codes].any(axis=1)
                if not taken.all():
                    return int(free[np.argmin(taken)] - codes[0])
                at = int(free[-1]) + 1
        return max(self.top, self.codes)

    def count(self, codes: np.ndarray, root: int, length: int, sequences: int) -> np.ndarray:
        """Occurrences of every sequence that begins with ``root``; code 0 is in none."""
        places = np.flatnonzero(codes[: max(0, len(codes) - length + 1)])
        state = np.full(len(places), self.base[0] + root, dtype=np.int64)
        for depth in range(length):
            code = codes[places + depth]
            to = self.base[state] + code
            good = (code > 0) & (self.check[to] == state)
            places, state = places[good], to[good]
        return np.bincount(self.accepts[state], minlength=sequences)


def _shard_counts(chunks: DataFrame, shard: pa.Table, length: int) -> DataFrame:
    """``lang``, ``words``, ``f`` of the phrases of a shard. The driver holds them as arrays, never word by word."""
    langs = shard.column("lang").combine_chunks().dictionary_encode()
    words = shard.column("words").combine_chunks().flatten().cast(pa.binary()).dictionary_encode()
    named, known = langs.dictionary.to_pylist(), b" ".join(words.dictionary.to_pylist())
    codes = words.indices.to_numpy().reshape(-1, length).astype(np.int32) + 1
    of = langs.indices.to_numpy().astype(np.int32)
    first = len(words.dictionary) + 1  # the root of the first language
    trie = DoubleArray(np.column_stack((of + first, codes)).astype(np.int32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = {lang: first + i for i, lang in enumerate(named)}
        each = known.split(b" ")
        own = {w: i for i, w in enumerate(each, 1)}
        total = np.zeros(len(codes), dtype=np.int64)
        for lang, words, ids in _rows(batches, "words", "ids"):
            if lang in roots:
                at = np.array([own.get(w, 0) for w in words] + [0], dtype=np.int64)
                total += trie.count(at[ids], roots[lang], length, len(codes))
        yield from _squeezed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = known.split(b" ")
        for piece, total in _summed(batches):
            seen = np.flatnonzero(total)
            at = piece * PIECE + seen
            columns = [
                pa.array(named, pa.string()).take(pa.array(of[at])),
                _phrases(each, codes[at].ravel() - 1, length),
                pa.array(total[seen]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "f"])

    # the counts of a task are a few rows of numbers, so that a phrase is written out once and not by every task
    pieces = chunks.select("lang", "words", "ids").mapInArrow(freeing(work), PIECES)
    return pieces.repartition("piece").mapInArrow(freeing(add), "lang string, words array<string>, f long")


def frequent_phrases(df: DataFrame, least: int, longest: int, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``words``, ``f`` of all words and phrases of ``least`` occurrences; ``lang``, ``n`` of all words."""
    docs = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunks = reliable_copy(docs.mapInArrow(freeing(_chunks), CHUNK))
    words = chunks.select("lang", "words", "n").mapInArrow(freeing(_counted), "lang string, word string, f long")
    words = reliable_copy(words.groupBy("lang", "word").agg(F.sum("f").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    amount = words.agg(F.sum("f")).first()[0] or 0
    pieces = 1 << max(FEWEST_PIECES - 1, amount // PIECE_WORDS).bit_length()
    level = reliable_copy(words.where(F.col("f") >= least).select("lang", F.array("word").alias("words"), "f"))
    found = level
    for length in range(2, longest + 1):
        candidates = _candidates(chunks, level, length, least, pieces)
        shards = -(-2 * candidates.count() // SHARD)
        counted = None
        for shard in range(shards):
            own = candidates.where(F.expr(f"pmod(xxhash64(lang, words), {shards}) = {shard}")).toArrow()
            if own.num_rows:
                # stored at once, so that the driver holds one trie at a time
                some = reliable_copy(_shard_counts(chunks, own, length).where(F.col("f") >= least))
                counted = some if counted is None else counted.unionByName(some)
        if counted is None:
            break
        level = counted
        found = found.unionByName(level)
    return found, totals


def collocations(
    df: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases."""
    found, totals = frequent_phrases(df, least, longest, text, lang)
    long = found.where(F.size("words") > 1)
    parts = [F.slice("words", start, F.size("words") - 1).alias("words") for start in (F.lit(1), F.lit(2))]
    inside = long.select("lang", parts[0], "f").unionByName(long.select("lang", parts[1], "f"))
    inside = inside.groupBy("lang", "words").agg(F.max("f").alias("most"))
    kept = long.join(inside, ["lang", "words"], "left").where("most IS NULL OR most < f").drop("most")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    cuts = cuts.join(found.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(found.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    exact = "cast({} AS decimal(19, 0))"
    up = f"cast(1000 * {exact.format('f')} AS decimal(22, 0)) * cast(n AS decimal(15, 0))"
    score = F.expr(f"({up}) div ({exact.format('l')} * cast(r AS decimal(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "words").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a"), F.first("n").alias("n")
    )
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.expr("pmod(xxhash64(phrase), 64)")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order)))
    best = best.where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
