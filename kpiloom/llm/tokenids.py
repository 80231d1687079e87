"""Token-ID output in a binary format of range-coded blocks.

A folder of the format has

* ``table``: the frequency of every token id, over the whole corpus, shared by all blocks;
* ``blocks``: Parquet rows below ``part=0``, ``part=1``, ..., each with one block of whole documents
  in ascending order of ids: their ids and sizes, the number of token ids before the block, the lanes,
  checkpoints, coded words and a CRC-32 of the token ids.

Blocks are independent, so they are decoded in parallel; a reader of some documents starts at the
checkpoint before them. A wrong checksum raises an error. Spark's writers commit the files, so lost
executors and repeated tasks leave nothing behind, and any file system that Spark writes will do.

Defined results: null text counts as empty, so it gives the end id alone; rows with equal document
ids are documents of their own, ordered by size and content; null document ids come first; a long
text makes a longer block; an empty table gives no documents. Other columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import rans
from kpiloom.llm.common import WordCache, binary_rows, freeing, text_chunks, unused_character
from kpiloom.sources.stage import checkpoint_folder

#: Words that a worker keeps, also from one task to the next.
CACHED_WORDS = 800_000
#: Bytes of text that are tokenized at once.
CHUNK = 2 << 20
#: New words, or joined texts of them, that the library encodes in one call; what it returns is large.
LIBRARY_WORDS = 256
#: New words of the usual form that are joined to one text.
JOINED_WORDS = 256
#: A Latin letter before ASCII punctuation other than the apostrophe.
PUNCTUATED = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}])([!-&(-/:-@\[-`{-~])"
#: Token ids of a block; only a single longer document makes more.
BLOCK = 1 << 18
#: Bytes of text in a part, about.
PART_BYTES = 64 << 20
FEWEST_PARTS = 16
#: Parquet's row groups and pages, in bytes, looked at after each row: a row is a block, and by default 100 of them
#: come before the first look, which a writer and a reader then hold as one page.
ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1}


class TokenCodec:
    """A tokenizer file, applied once to each different word of a chunk where that is exact.

    The byte-level pattern never goes from other characters on to white space, nor from letters on to
    punctuation, so a text can be cut before each run of white space and between a Latin letter and
    ASCII punctuation. The library takes the strings of added tokens out first, so what is between
    them is a text of its own. Texts are encoded whole if the file has another pre-tokenizer, or added
    tokens with white space or with rules on what is around them.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(tokenizer_file)
        setup = json.loads(self.library.to_str())
        before = setup["pre_tokenizer"] or {}
        self.cuts = setup["normalizer"] is None and (
            before.get("type"), before.get("use_regex"), before.get("add_prefix_space")
        ) == ("ByteLevel", True, False)
        added = {t.content: (i, t) for i, t in self.library.get_added_tokens_decoder().items()}
        self.cuts &= not any(
            t.single_word or t.lstrip or t.rstrip or any(map(str.isspace, t.content)) for _, t in added.values()
        )
        self.added_ids = {content: i for content, (i, _) in added.items()}
        self.added = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.size = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
        self.cache = WordCache(self._words, CACHED_WORDS)
        #: Bytes of each token: the byte-level alphabet has a character for every byte.
        self.bytes = np.zeros(self.size, dtype=np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        self.spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [np.empty(0, np.int32)], []
        for at in range(0, len(texts), LIBRARY_WORDS):
            some = self.library.encode_batch_fast(
                texts[at : at + LIBRARY_WORDS], add_special_tokens=False
            )
            ids = [x.ids for x in some]
            sizes += map(len, ids)
            parts.append(np.array(list(chain.from_iterable(ids)), dtype=np.int32))
        return np.concatenate(parts), np.array(sizes, dtype=np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, with words of the usual form joined: a space or newline, then others.

        One such word ends where the next begins, and no token goes across, so the sizes follow from
        the bytes of the tokens.
        """
        usual = np.array([w[:1] in (" ", "\n") and not w[-1].isspace() for w in words], dtype=bool)
        some = list(compress(words, usual))
        texts = ["".join(some[at : at + JOINED_WORDS]) for at in range(0, len(some), JOINED_WORDS)]
        ids = self._each(texts)[0]
        ends = np.cumsum(pc.binary_length(pa.array(some, pa.string())).to_numpy().astype(np.int64))
        spans = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
        rest, rest_sizes = self._each(list(compress(words, ~usual)))
        sizes = np.empty(len(words), dtype=np.int64)
        sizes[usual], sizes[~usual] = np.diff(spans, prepend=0), rest_sizes
        out = np.empty(len(ids) + len(rest), dtype=np.int32)
        out[np.repeat(usual, sizes)], out[np.repeat(~usual, sizes)] = ids, rest
        return out, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            return self._each(texts.to_pylist())
        if self.added and pc.any(pc.match_substring_regex(texts, self.added)).as_py():
            return self._around_added(texts)
        return self._plain(texts)

    def _around_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts with strings of added tokens."""
        parts = [re.split(f"({self.added})", t) for t in texts.to_pylist()]
        flat = list(chain.from_iterable(parts))
        plain = np.concatenate([np.arange(len(p)) % 2 == 0 for p in parts])
        ids, plain_sizes = self._plain(pa.array(list(compress(flat, plain)), pa.string()))
        sizes = np.ones(len(flat), dtype=np.int64)
        sizes[plain] = plain_sizes
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        out[np.repeat(plain, sizes)] = ids
        out[np.repeat(~plain, sizes)] = [self.added_ids[p] for p in compress(flat, ~plain)]
        ends = np.cumsum([len(p) for p in parts])
        return out, np.add.reduceat(sizes, ends - [len(p) for p in parts])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts without strings of added tokens."""
        cut = unused_character(texts, "".join([" \n\\0123456789", *self.spaces]))
        for space in " \n":
            texts = pc.replace_substring(texts, space, cut + space)
        for space in " \n":  # no cut inside a run
            texts = pc.replace_substring(texts, space + cut, space)
        others = f"([{''.join(self.spaces)}])" + re.escape(cut)
        if pc.any(pc.match_substring_regex(texts, others)).as_py():
            texts = pc.replace_substring_regex(texts, others, "\\1")
        texts = pc.replace_substring_regex(texts, PUNCTUATED, f"\\1{cut}\\2")
        lists = pc.split_pattern(texts, cut)
        return self.cache.texts(lists.flatten(), np.diff(lists.offsets.to_numpy()))


@lru_cache(maxsize=2)
def codec(tokenizer_file: str) -> TokenCodec:
    return TokenCodec(tokenizer_file)


def _coded(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """``part``, ``id``, ``n``, ``ids``: compressed token ids of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squeeze = codec(tokenizer_file), zstandard.ZstdCompressor(level=1)
        for chunk in text_chunks(batches, "text", CHUNK):
            ids, sizes = own.encode(chunk.column("text"))
            ends = np.cumsum(sizes + 1)
            out = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype="<u4")
            inside = np.ones(len(out), dtype=bool)
            inside[ends - 1] = False
            out[inside] = ids
            packed = [squeeze.compress(_planes(x)) for x in np.split(out, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("part"), chunk.column("id"), pa.array(sizes + 1, pa.int32()), pa.array(packed)],
                ["part", "id", "n", "ids"],
            )

    return docs.mapInArrow(freeing(work), "part int, id long, n int, ids binary")


def _planes(ids: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, and so on."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


RAW = "part int, block int, first long, n int, docs array<long>, sizes array<int>, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents gathered to blocks; rows come in order of part and id."""
    squeeze, unsqueeze = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    part, block, first, size, held = None, 0, 0, 0, []

    def made() -> pa.RecordBatch:
        ids = np.concatenate([_from_planes(unsqueeze.decompress(x)) for _, _, x in held])
        row = [part, block, first, len(ids), [d for d, _, _ in held], [n for _, n, _ in held]]
        names = [x.split()[0] for x in RAW.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        values = [*row, squeeze.compress(_planes(ids))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        numbers = zip(*(batch.column(c).to_pylist() for c in ("part", "id", "n")))
        for (of, id, n), ids in zip(numbers, batch.column("ids")):
            if held and (of != part or size + n > BLOCK):
                yield made()
                block, first, held, size = block + 1, first + size, [], 0
            if of != part:
                part, block, first = of, 0, 0
            held.append((id, n, ids.as_py()))  # the bytes of one document at a time
            size += n
    if held:
        yield made()


def _counts(blocks: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs. What reaches the driver is one row per id of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze, total = zstandard.ZstdDecompressor(), np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(_from_planes(unsqueeze.decompress(ids.as_buffer())), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    rows = blocks.select("ids").mapInArrow(freeing(work), "token long, n long")
    counts = np.zeros(vocabulary, dtype=np.int64)
    for row in rows.groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row.token] = row.n
    return counts


CODED = (
    "part int, block int, first long, n int, docs array<long>, sizes array<int>, "
    "lanes int, states binary, places binary, words binary, crc32 long"
)


def write_ids(
    df: DataFrame, path: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode the texts, append ``end_id`` to each and write them in ascending order of ``key``."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(FEWEST_PARTS, amount // PART_BYTES)
    splits = docs.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    edges = F.array(*map(F.lit, sorted(set(splits or []))))
    part = F.size(F.filter(edges, lambda x: x < F.col("id"))) if splits else F.lit(0)
    docs = docs.withColumn("part", F.coalesce(F.when(F.col("id").isNotNull(), part), F.lit(0)))
    coded = _coded(docs.select("part", "id", "text"), tokenizer_file, end_id)
    ordered = coded.repartition(parts, "part").sortWithinPartitions("part", "id", "n", "ids")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/kpiloom-{uuid.uuid4()}"
    ordered.mapInArrow(freeing(_blocks), RAW).write.options(**ROW_GROUPS).parquet(folder)
    raw = spark.read.parquet(folder)
    del coded, ordered
    gc.collect()
    spark._jvm.System.gc()  # lets Spark drop the shuffle files, which nothing needs any more

    vocabulary = max(codec(tokenizer_file).size, end_id + 1)
    share = rans.frequencies(_counts(raw, vocabulary), max(16, (4 * vocabulary).bit_length()))
    sizes = raw.groupBy("part").agg(F.sum("n").alias("n")).collect()
    before, total = {}, 0
    for row in sorted(sizes, key=lambda r: r.part):
        before[row.part], total = total, total + row.n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unsqueeze = rans.Table(share), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).select(["part", "first", "ids"]).to_pylist()[0]
                ids = _from_planes(unsqueeze.decompress(row["ids"]))
                made = table.encode(ids)
                new = [
                    pa.array([before[row["part"]] + row["first"]], pa.int64()),
                    pa.array([made.lanes], pa.int32()),
                    *(pa.array([x.tobytes()], pa.binary()) for x in made[1:]),
                    pa.array([zlib.crc32(ids.tobytes())], pa.int64()),
                ]
                old = [batch.column(c).slice(i, 1) for c in ("part", "block", "n", "docs", "sizes")]
                yield pa.RecordBatch.from_arrays(
                    [*old[:2], new[0], *old[2:], *new[1:]], [x.split()[0] for x in CODED.split(", ")]
                )

    made = raw.mapInArrow(freeing(work), CODED).write.mode("overwrite").options(**ROW_GROUPS)
    made.partitionBy("part").parquet(f"{path}/blocks")
    rows = [(i, int(n)) for i, n in enumerate(share)]
    table = spark.createDataFrame(rows, "token int, frequency long").coalesce(1)
    table.write.mode("overwrite").parquet(f"{path}/table")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every document."""
    rows = spark.read.parquet(f"{path}/table").orderBy("token").collect()  # the vocabulary
    share = np.array([r.frequency for r in rows], dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(share)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = table.decode(block_of(row), 0, row["n"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"]:
                    raise ValueError(f"part {row['part']}, block {row['block']}: wrong checksum")
                sizes = np.array(row["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["docs"], pa.int64()),
                        pa.array(row["first"] + ends - sizes),
                        pa.array(sizes),
                        binary_rows(ids, 4 * ends),
                    ],
                    ["id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    found = blocks.mapInArrow(freeing(work), "id long, start long, n_tokens long, ids binary")
    return found.withColumnRenamed("id", key)


def block_of(row: dict) -> rans.Block:
    states = np.frombuffer(row["states"], "<u8").reshape(-1, row["lanes"])
    places, words = (np.frombuffer(row[c], "<u4") for c in ("places", "words"))
    return rans.Block(row["lanes"], states, places, words)
