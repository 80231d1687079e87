"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits in lower case; shingles are five words (for an item with fewer
words, all its words). Every benchmark item has a 64-bit SimHash over its shingles, weighted by how
often each occurs. In the documents, windows of exactly as many words as an item are fingerprinted in
the same way. Items whose fingerprint is within ``RADIUS`` of a window's are found by multi-index
Hamming blocks: the 64 bits are cut into four blocks of 16; of ``RADIUS`` = 15 differing bits, one
block has at most three, so each block of an item is filed under all values within three bits, and
looking up the four blocks of a window finds every item within the radius, without exception. What
is found is verified by the exact weighted Jaccard similarity of the shingles (sum of the smaller
counts over sum of the larger ones), which must be ``SIMILARITY`` or more.

Windows that cannot reach the similarity are not fingerprinted: of the shingles of a similar window
the share ``SIMILARITY`` at least are shingles of the item, so that many must occur in the benchmark
at all. This loses nothing, whatever the benchmark.

The benchmark is cut into blocks of ``ITEMS`` different items and ``ITEM_WORDS`` words at most, and
the documents are read once for each block, so what is sent to the executors has a fixed bound. No
texts are shuffled. The result has a row for each document and item that match: its best window.

Defined results: null texts and texts without a word match nothing, as do items without a word;
equal items share their matches, each under its own id; repeated rows give repeated results; null
ids stay null; a long text is read whole; an empty table on either side gives an empty result. Only
the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import text_chunks

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
ITEMS = 4096
ITEM_WORDS = 1 << 20
#: Windows that are fingerprinted together.
TOGETHER = 1 << 15
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, each different word once."""
    import xxhash

    coded = pa.array(words, pa.string()).dictionary_encode()
    each = [xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()]
    return np.array(each, dtype=np.uint64)[coded.indices.to_numpy()]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` words in a row."""
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def simhashes(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints of windows of ``count`` shingles, by running sums of their bits."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(bits) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[starts + count] - sums[starts]
    return np.packbits(2 * ones > count, axis=1).view(np.uint64).ravel()


class BlockIndex:
    """Fingerprints filed under every value of each block that is near enough."""

    def __init__(self, marks: np.ndarray, radius: int, blocks: int = BLOCKS):
        self.marks, self.radius, self.blocks, self.width = marks, radius, blocks, 64 // blocks
        near = [0]
        for flips in range(1, radius // blocks + 1):
            near += [sum(1 << b for b in bits) for bits in combinations(range(self.width), flips)]
        self.filed, self.ends = [], []
        for block in range(blocks):
            values = self._block(marks, block)[:, None] ^ np.array(near)[None, :]
            order = np.argsort(values.ravel(), kind="stable")
            self.filed.append((order // len(near)).astype(np.int32))
            self.ends.append(np.searchsorted(values.ravel()[order], np.arange((1 << self.width) + 1)))

    def _block(self, marks: np.ndarray, block: int) -> np.ndarray:
        shift = np.uint64(block * self.width)
        return ((marks >> shift) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def within(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``marks``, place in the index) within the radius, each once."""
        found = [np.empty(0, dtype=np.int64)]
        for at in range(0, len(marks), 4096):
            some = marks[at : at + 4096]
            for block in range(self.blocks):
                value = self._block(some, block)
                low, high = self.ends[block][value], self.ends[block][value + 1]
                row = np.repeat(np.arange(len(some)), high - low)
                shift = np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
                item = self.filed[block][shift + np.arange(len(row))]
                near = np.bitwise_count(some[row] ^ self.marks[item]) <= self.radius
                found.append((at + row[near]) * len(self.marks) + item[near])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.marks)), both % max(1, len(self.marks))


class Benchmark:
    """Items with one shingle width: fingerprints, their index, and shingle counts."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int):
        self.width, self.numbers = width, [n for n, _ in items]
        own = [shingle_hashes(word_hashes(words), width) for _, words in items]
        self.sizes = np.array([len(s) for s in own], dtype=np.int64)
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))) for s in own]
        marks = [simhashes(s, np.array([0]), len(s))[0] for s in own]
        self.index = BlockIndex(np.array(marks, dtype=np.uint64), RADIUS)
        self.shingles = np.unique(np.concatenate(own))

    def matches(self, hashes: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best similarity and first word for each matching item of one document."""
        shingles = shingle_hashes(hashes, self.width)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        known = np.concatenate(([0], np.cumsum(self.shingles[at] == shingles)))
        best: dict[int, tuple[float, int]] = {}
        if not known[-1]:
            return best
        for size in np.unique(self.sizes).tolist():
            inside = known[size:] - known[:-size] if size < len(known) else known[:0]
            starts = np.flatnonzero(inside >= max(1, SIMILARITY * size - 1e-9))
            for part in np.split(starts, range(TOGETHER, len(starts), TOGETHER)):
                if len(part):
                    self._verify(shingles, part, size, best)
        return best

    def _verify(self, shingles: np.ndarray, starts: np.ndarray, size: int, best: dict) -> None:
        low, high = starts[0], starts[-1] + size
        marks = simhashes(shingles[low:high], starts - low, size)
        for place, item in zip(*(x.tolist() for x in self.index.within(marks))):
            if self.sizes[item] != size:
                continue
            start, own = int(starts[place]), self.counts[item]
            seen: dict[int, int] = {}
            for s in shingles[start : start + size].tolist():
                seen[s] = seen.get(s, 0) + 1
            shared = sum(min(n, own.get(s, 0)) for s, n in seen.items())
            similarity = shared / (2 * size - shared)
            if similarity >= SIMILARITY and similarity > best.get(item, (0.0, 0))[0]:
                best[item] = (similarity, start)


def _blocks_of_items(items: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """Ids and words of items, a bounded number at a time."""
    block: list[tuple[object, list[str]]] = []
    size = 0
    for row in items.toLocalIterator():
        words = words_of(row.text)
        if words and block and (len(block) >= ITEMS or size + len(words) > ITEM_WORDS):
            yield block
            block, size = [], 0
        if words:
            block.append((row.item, words))
            size += len(words)
    if block:
        yield block


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``key``, ``item``, ``start`` and ``words`` (place and size of the window), ``similarity``."""
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    kinds = [frame.schema[0].dataType.simpleString() for frame in (docs, items)]
    schema = "id {}, item {}, start long, words long, similarity double".format(*kinds)
    item_kind = items.limit(0).toArrow().schema.field("item").type
    found = [_matches(docs, block, schema, item_kind) for block in _blocks_of_items(items)]
    if not found:
        found = [df.sparkSession.createDataFrame([], schema)]
    out = reduce(DataFrame.unionAll, found)
    return out.toDF(key, item, "start", "words", "similarity")


def _matches(docs: DataFrame, block: list, schema: str, item_kind: pa.DataType) -> DataFrame:
    numbers = [n for n, _ in block]
    by_words: dict[tuple, list[int]] = {}
    for place, (_, words) in enumerate(block):
        by_words.setdefault(tuple(words), []).append(place)
    different = list(by_words)
    same = list(by_words.values())
    by_width: dict[int, list] = {}
    for place, words in enumerate(different):
        by_width.setdefault(min(SHINGLE, len(words)), []).append((place, list(words)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Benchmark(items, width) for width, items in by_width.items()]
        for chunk in text_chunks(batches, "text"):
            texts = [words_of(t) for t in chunk.column("text").to_pylist()]
            sizes = [len(w) for w in texts]
            hashes = word_hashes([w for words in texts for w in words])
            rows = {"row": [], "item": [], "start": [], "words": [], "similarity": []}
            for row, own in enumerate(np.split(hashes, np.cumsum(sizes)[:-1])):
                for part in parts:
                    for local, (similarity, start) in part.matches(own).items():
                        place = part.numbers[local]
                        for twin in same[place]:
                            rows["row"].append(row)
                            rows["item"].append(numbers[twin])
                            rows["start"].append(start)
                            rows["words"].append(len(different[place]))
                            rows["similarity"].append(similarity)
            ids = chunk.column("id").take(pa.array(rows.pop("row"), pa.int64()))
            kinds = [item_kind, pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array(v, kind) for v, kind in zip(rows.values(), kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", *rows])

    return docs.mapInArrow(work, schema)
