"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link if they differ in at most two. Equal fingerprints are one node. A
fingerprint has three segments of 22, 21 and 21 bits. Of two linked fingerprints, some segment is
equal while the next one (cyclically) differs in at most one bit: two differing bits leave no other
way. So the value of a segment with the indices of the Golay codewords near the next one makes keys
of which linked fingerprints share one. Fingerprints that share a key are joined and verified.

A key that more than ``CROWD`` different fingerprints share would give too many pairs. Its
fingerprints are linked exactly in another way: two of them are within distance two if and only if
some point is within distance one of both, so each is grouped under its 65 points and linked to the
smallest fingerprint there. Work is in proportion to the fingerprints in either case.

Defined results: null and empty texts, and those without a word, have fingerprint zero and link like
any other; texts with fewer words than a shingle are one shingle; repeated rows stay, each with its
component; a null ``doc_id`` stays null and never names a component that has another id; an empty
table gives an empty table. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import ragged, text_chunks
from kpiloom.llm.components import components
from kpiloom.llm.golay import codeword_keys
from kpiloom.sources.stage import reliable_copy

SEED = 42
RADIUS = 2
#: Segments of a fingerprint: lowest bit and width.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Different fingerprints of a key that are compared in pairs.
CROWD = 64


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of one text over the XXH64 of its word shingles, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - words_per_shingle].tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[words_per_shingle - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "little")


def fingerprints(
    df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3
) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long, of every row."""
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            marks = [fingerprint(t, words_per_shingle) for t in chunk.column("text").to_pylist()]
            fp = pa.array(np.array(marks, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([chunk.column("key"), fp], ["key", "fp"])

    return picked.mapInArrow(work, f"key {kind}, fp long").withColumnRenamed("key", key)


def golay_keys(fps: DataFrame) -> DataFrame:
    """``key``, ``fp``: the keys of each fingerprint, about nine and a half on average."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("fp").to_numpy().view(np.uint64)
            for i, (low, width) in enumerate(SEGMENTS):
                next_low, next_width = SEGMENTS[(i + 1) % 3]
                own = (marks >> np.uint64(low)) & np.uint64((1 << width) - 1)
                other = (marks >> np.uint64(next_low)) & np.uint64((1 << next_width) - 1)
                row, index = codeword_keys(other)
                key = (i << 40) | (own.astype(np.int64)[row] << 12) | index
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(marks.view(np.int64)[row])], ["key", "fp"]
                )

    return fps.select("fp").mapInArrow(work, "key long, fp long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a``, ``b``: links that join the same fingerprints as all pairs within the radius do.

    ``fps`` has each fingerprint once, in ``fp``.
    """
    keys = golay_keys(fps)
    sizes = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = reliable_copy(keys.join(sizes, "key"))
    few = shared.where(F.col("members") <= crowd)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where(F.expr(f"a < b AND bit_count(a ^ b) <= {RADIUS}"))
        .select("a", "b")
        .distinct()
    )
    crowded = shared.where(F.col("members") > crowd).select("fp").distinct()
    points = crowded.select(
        "fp",
        F.explode(
            F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
        ).alias("point"),
    )
    heads = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n"))
    stars = points.join(heads.where("n > 1"), "point").where("fp > a")
    return pairs.unionByName(stars.select("a", F.col("fp").alias("b")).distinct())


def likely_pairs(marked: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``: nodes whose fingerprints differ in at most ``radius`` bits, of those that share a key.

    ``marked`` has each ``node`` once, with its ``fp``. A key is a Golay codeword of each of two segments, about
    thirty for a fingerprint: those that differ in three bits or fewer share one, others the more seldom the
    further they are apart. Each node is paired with the smallest of its key, so that a key with many nodes
    gives as many pairs as it has nodes. For pairs that are verified, and completed in another way.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, signed = (batch.column(c).to_numpy() for c in ("node", "fp"))
            marks = signed.view(np.uint64)
            near = [codeword_keys(marks >> np.uint64(low) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS]
            for i, (row, index) in enumerate(near):
                others, other_index = near[(i + 1) % 3]
                starts = np.searchsorted(others, row)
                counts = np.searchsorted(others, row, side="right") - starts
                key = i << 24 | np.repeat(index, counts) << 12 | other_index[ragged(starts, counts)]
                of = np.repeat(row, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(nodes[of]), pa.array(signed[of])], ["key", "node", "fp"]
                )

    keys = marked.select("node", "fp").mapInArrow(work, "key long, node long, fp long")
    heads = keys.groupBy("key").agg(
        F.min("node").alias("a"), F.min_by("fp", "node").alias("head_fp"), F.count("*").alias("n")
    )
    pairs = keys.join(heads.where("n > 1"), "key").where(f"node > a AND bit_count(fp ^ head_fp) <= {radius}")
    return pairs.select("a", F.col("node").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3
) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key that links reach, of every row."""
    marked = reliable_copy(fingerprints(df, key, text, words_per_shingle))
    nodes = reliable_copy(marked.groupBy("fp").agg(F.min(key).alias("first_key")))
    heads = components(links(nodes)).withColumnRenamed("node", "fp")
    linked = nodes.join(heads, "fp")
    lowest = linked.groupBy("head").agg(F.min("first_key").alias("lowest"))
    named = nodes.join(linked.join(lowest, "head").select("fp", "lowest"), "fp", "left")
    named = named.select("fp", F.coalesce("lowest", "first_key").alias("component_id"))
    return marked.join(named, "fp").select(key, "fp", "component_id")
