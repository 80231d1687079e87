"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once in a task; a single longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_chunks(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start, used = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, used + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, used = stop, int(ends[stop - 1])


def freeing(
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which Arrow's pool and the C library give free memory back: a worker stays for other tasks."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return worked


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    top = max(total, int(starts.max(initial=0)) + total)
    kind = np.int32 if top < 1 << 31 else np.int64
    out = np.repeat((starts - ends + lengths).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``data``; ``ends`` in bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    raw = pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), raw])


class WordCache:
    """Ids of words that a worker has met; when it holds ``limit`` words it starts afresh.

    ``encode`` gives the ids of a list of different words, one after another, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.sizes = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def texts(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of so many words each, one after another, and how many each text has."""
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slots) > self.limit:
            self.forget()
        slot = np.fromiter(map(self.slots.get, different, repeat(-1)), np.int64, count=len(different))
        unknown = np.flatnonzero(slot < 0)
        if len(unknown):
            new = [different[i] for i in unknown]
            slot[unknown] = np.arange(len(self.slots), len(self.slots) + len(new))
            self.slots.update(zip(new, slot[unknown].tolist()))
            ids, sizes = self.encode(new)
            self.ids = np.concatenate((self.ids, ids))
            self.sizes = np.concatenate((self.sizes, sizes))
        slot = slot[coded.indices.to_numpy()]
        sizes = self.sizes[slot]
        starts = (np.cumsum(self.sizes) - self.sizes)[slot]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        return self.ids[ragged(starts, sizes)], np.diff(ends)


def unused_character(texts: pa.Array, besides: str = " \n") -> str:
    """The first character that none of the texts has."""
    return next(
        chr(c)
        for c in range(1, 0x110000)
        if chr(c) not in besides and not pc.any(pc.match_substring(texts, chr(c))).as_py()
    )
