"""Substring dedup: word windows that an earlier document also has are removed.

Every window of ``width`` consecutive words gets a Rabin-Karp hash: the words' 64-bit hashes as
digits of a number modulo 2^64, twice, with two bases and independent digits. Spark deals the window
hashes out to buckets by the second number's top bits, and each bucket finds for every window hash
the smallest document id it starts in. Windows that start in a document with a smaller id come back
to their document, where they are merged into maximal intervals of words to remove.

Only 56 bits of the first number are sent with a window, beside the bucket, of which there are
``2^b``. A false match needs equal numbers in 56 + b bits; the buckets grow with the input, at least
32 of them: below 10^-2 for 10^8 windows, and about one window in 10^10 for 10^13.

Bounded memory: a bucket is read in order of document ids, a cell of ids at a time; what is
remembered is each different hash once, however many documents share it. So a passage that a third
of all documents share costs no more memory than any other.

Defined results: null texts have no words; texts with fewer words than a window keep all of them; a
window that repeats only inside its document, or in rows with the same id, stays; documents with a
null id are left as they are and remove nothing elsewhere; repeated rows stay, each treated alike;
an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import text_chunks

WIDTH = 13
#: Odd bases of the two hash numbers.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows of a bucket, about, and the fewest buckets.
BUCKET_WINDOWS = 4 << 20
LEAST_BUCKETS = 32
#: Documents of a cell, about.
CELL_DOCUMENTS = 2048
#: Windows a bucket looks at together.
TOGETHER = 2 << 20
LOW56 = np.uint64((1 << 56) - 1)


def word_lists(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between ASCII white space, coded, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    counts = np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
    return flat.filter(full).dictionary_encode(), counts


def window_hashes(
    words: pa.DictionaryArray, counts: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hash numbers of every window, and how many windows each text has."""
    import xxhash

    raw = b"".join(xxhash.xxh3_128_digest(w) for w in words.dictionary.to_pylist())
    digits = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
    codes = words.indices.to_numpy()
    windows = np.maximum(counts - width + 1, 0)
    ends = np.cumsum(counts)
    inside = np.ones(len(codes), dtype=bool)
    for back in range(1, width):
        short = ends - back
        inside[short[short >= ends - counts]] = False
    found = []
    for i, base in enumerate(BASES):
        digit, number = digits[:, i][codes], np.zeros(max(0, len(codes) - width + 1), np.uint64)
        for k in range(width):
            number *= np.uint64(base)
            number += digit[k : k + len(number)]
        found.append(number[inside[: len(number)]])
    return found[0], found[1], windows


def _sent(windows: DataFrame, width: int, bits: int, cell: float, lowest: int) -> DataFrame:
    """A row for each chunk of texts, bucket and cell of ids: ids, windows of each id, hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            ids = chunk.column("id").to_numpy()
            first, second, sizes = window_hashes(*word_lists(chunk.column("text")), width)
            owner = np.repeat(np.arange(len(ids)), sizes)
            cells = ((ids - lowest) / cell).astype(np.int64)
            bucket = (second >> np.uint64(64 - bits)).astype(np.int64)
            place = np.lexsort((ids, cells))
            rank = np.empty(len(ids), dtype=np.int64)
            rank[place] = np.arange(len(ids))
            order = np.argsort(bucket * len(ids) + rank[owner], kind="stable")
            owner, bucket, sent = owner[order], bucket[order], first[order]
            data = sent.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
            group = bucket * (cells.max(initial=0) + 1) + cells[owner]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            rows = {"bucket": [], "cell": [], "ids": [], "sizes": [], "hashes": []}
            for a, b in zip(starts, np.append(starts[1:], len(group))):
                runs = a + np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                rows["bucket"].append(int(bucket[a]))
                rows["cell"].append(int(cells[owner[a]]))
                rows["ids"].append(ids[owner[runs]].astype("<i8").tobytes())
                rows["sizes"].append(np.diff(np.append(runs, b)).astype("<u4").tobytes())
                rows["hashes"].append(data[a:b].tobytes())
            yield pa.RecordBatch.from_pydict(rows, SENT)

    return windows.mapInArrow(work, "bucket long, cell long, ids binary, sizes binary, hashes binary")


SENT = pa.schema(
    [("bucket", pa.int64()), ("cell", pa.int64())] + [(n, pa.binary()) for n in ("ids", "sizes", "hashes")]
)


class Seen:
    """Window hashes so far: sorted runs, each at least twice as long as the next."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def known(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), dtype=bool)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, hashes), len(run) - 1)
            found |= run[at] == hashes
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Sorted hashes that are not known yet."""
        while self.runs and len(self.runs[-1]) < 2 * len(hashes):
            hashes = np.sort(np.concatenate((self.runs.pop(), hashes)), kind="stable")
        if len(hashes):
            self.runs.append(hashes)


def _repeats(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """``id``, ``hashes``: window hashes that also start in a document with a smaller id.

    Takes the rows of whole buckets, in order of bucket and cell.
    """
    seen, bucket, held, size, cell = Seen(), None, [], 0, None

    def work() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.repeat(i, s) for i, s, _ in held])
        hashes = np.concatenate([h for _, _, h in held])
        order = np.lexsort((ids, hashes))
        ids, hashes = ids[order], hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        known = seen.known(hashes[first])
        counts = np.diff(np.append(first, len(ids)))
        smallest = np.repeat(ids[first], counts)
        gone = np.flatnonzero(np.repeat(known, counts) | (ids > smallest))
        seen.add(hashes[first][~known])
        gone = gone[np.argsort(ids[gone], kind="stable")]
        ids, hashes = ids[gone], hashes[gone]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
        ends = np.append(starts[1:], len(ids))
        data = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
        yield pa.RecordBatch.from_pydict(
            {"id": ids[starts], "hashes": [data[a:b].tobytes() for a, b in zip(starts, ends)]},
            pa.schema([("id", pa.int64()), ("hashes", pa.binary())]),
        )

    for batch in batches:
        for row in batch.to_pylist():
            place = (row["bucket"], row["cell"])
            if held and (place[0] != bucket or (size >= together and place[1] != cell)):
                yield from work()
                held, size = [], 0
            if place[0] != bucket:
                seen = Seen()
            bucket, cell = place
            hashes = unpacked(row["hashes"])
            held.append((np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<u4"), hashes))
            size += len(hashes)
    if held:
        yield from work()


def unpacked(data: bytes) -> np.ndarray:
    """Numbers of seven bytes each."""
    out = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def repeated_windows(
    df: DataFrame, key: str, text: str, width: int = WIDTH, together: int = TOGETHER
) -> DataFrame:
    """``id``, ``hashes`` (binary, one or more rows per id): windows to remove from each document."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _repeats(batches, together)

    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(
        "id IS NOT NULL AND text IS NOT NULL"
    )
    about = docs.agg(
        F.sum(F.octet_length("text") / 6), F.count("*"), F.min("id"), F.max("id")
    ).first()
    words, rows, lowest, highest = (x or 0 for x in about)
    buckets = max(LEAST_BUCKETS, int(words) // BUCKET_WINDOWS)
    bits = (buckets - 1).bit_length()
    cell = max(1.0, (highest - lowest + 1) / max(rows, 1) * CELL_DOCUMENTS)
    sent = _sent(docs, width, bits, cell, lowest)
    return (
        sent.repartition(1 << bits, "bucket")
        .sortWithinPartitions("bucket", "cell")
        .mapInArrow(repeats, "id long, hashes binary")
    )


def remove_repeats(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    together: int = TOGETHER,
) -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept`` (words joined by a space), ``removed``.

    ``removed`` lists the maximal intervals of words that went: first word, and the one after the last.
    """
    gone = repeated_windows(df, key, text, width, together)
    gone = gone.groupBy("id").agg(F.collect_list("hashes").alias("hashes"))
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    joined = docs.join(gone, docs["key"].cast("long") == gone["id"], "left").select(
        "key", "text", "hashes"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            rows = {"key": chunk.column("key"), "n_words": [], "n_removed": [], "kept": [], "removed": []}
            words, counts = word_lists(chunk.column("text"))
            first, _, windows = window_hashes(words, counts, width)
            first, start, spot = first & LOW56, 0, 0
            plain = np.array(words.dictionary.to_pylist(), dtype=object)
            for hashes, n, m in zip(chunk.column("hashes").to_pylist(), counts.tolist(), windows.tolist()):
                own = plain[words.indices[spot : spot + n].to_numpy()]
                covered = np.zeros(n, dtype=bool)
                if hashes and m:
                    bad = np.isin(first[start : start + m], unpacked(b"".join(hashes)))
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, np.flatnonzero(bad), 1)
                    np.add.at(edge, np.flatnonzero(bad) + width, -1)
                    covered = np.cumsum(edge)[:n] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
                rows["n_words"].append(n)
                rows["n_removed"].append(int(covered.sum()))
                rows["kept"].append(" ".join(own[~covered].tolist()))
                rows["removed"].append(
                    [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
                )
                start, spot = start + m, spot + n
            yield pa.RecordBatch.from_pydict(rows, CLEANED.insert(0, chunk.schema.field("key")))

    out = joined.mapInArrow(
        work,
        f"key {kind}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>",
    )
    return out.withColumnRenamed("key", key)


CLEANED = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept", pa.string()),
        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
