"""The coder's round trip, and token ids read back against the library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import DATA, edge, texts  # noqa: F401

from kpiloom.llm import queries, rans, tokenids

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 400_000])
def test_blocks_decode_from_any_place(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 999).astype(np.int64)
    table = rans.Table(rans.frequencies(np.bincount(ids, minlength=1000), 16))
    block = table.encode(ids)
    assert (table.decode(block, 0, n) == ids).all()
    for start in rng.integers(0, max(n, 1), 5).tolist():
        stop = min(n, start + 300)
        assert (table.decode(block, start, stop) == ids[start:stop]).all()


def test_one_symbol_alone():
    table = rans.Table(rans.frequencies(np.array([0, 9, 0]), 8))
    assert table.decode(table.encode(np.ones(70, np.int64)), 0, 70).tolist() == [1] * 70


def test_many_rare_symbols_keep_a_share():
    share = rans.frequencies(np.array([10**12] + [1] * 200), 8)
    assert share.sum() == 256 and share.min() == 1


def test_words_encode_as_whole_texts():
    rng = random.Random(4)
    parts = ["a", "The", "'s", "'", " ", "  ", "\n", "\t", " ", "　", "1", "é", "!", "😀", "<|endoftext|>", "\x1c", "\x0b", "\r"]
    cases = ["", None, " ", "\n ", "x" * 3000] + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(800)]
    codec = tokenids.codec(FILE)
    assert codec.cuts
    ids, sizes = codec.encode(pa.array(cases))
    for text, got in zip(cases, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == codec.library.encode(text or "", add_special_tokens=False).ids


def expected(rows):
    start = 0
    for i, text in rows:
        ids = [*tokenids.codec(FILE).library.encode(text or "", add_special_tokens=False).ids, 2]
        yield i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_query_against_the_library(spark, texts):  # noqa: F811
    got = sorted(tuple(r) for r in queries.op3_token_ids(spark, DATA).collect())
    assert got == list(expected(sorted(texts.items())))


def test_edge_rows(spark, edge, tmp_path):  # noqa: F811
    tokenids.write_ids(edge, f"{tmp_path}/ids", FILE, 2)
    got = tokenids.read_ids(spark, f"{tmp_path}/ids").orderBy("start").collect()
    rows = sorted([(r.doc_id, r.text) for r in edge.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got] == list(expected(rows))
    tokenids.write_ids(edge.limit(0), f"{tmp_path}/none", FILE, 2)
    assert tokenids.read_ids(spark, f"{tmp_path}/none").collect() == []


def test_damage_is_noticed(spark, edge, tmp_path):  # noqa: F811
    tokenids.write_ids(edge, f"{tmp_path}/ids", FILE, 2)
    blocks = spark.read.schema(tokenids.CODED).parquet(f"{tmp_path}/ids/blocks")
    blocks.withColumn("crc32", blocks.crc32 + 1).write.parquet(f"{tmp_path}/bad/blocks")
    spark.read.parquet(f"{tmp_path}/ids/table").write.parquet(f"{tmp_path}/bad/table")
    with pytest.raises(Exception, match="wrong checksum"):
        tokenids.read_ids(spark, f"{tmp_path}/bad").collect()


def test_added_tokens_encode_as_the_library_as_loaded():
    import tokenizers

    fresh = tokenizers.Tokenizer.from_file(FILE)
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "one", " two", "a|", "<", "é"]
    cases = ["one <|endoftext|> two", "<|endoftext|>", "<|endoftext|><|endoftext|>", "plain text", "", None]
    cases += ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)]
    ids, sizes = tokenids.codec(FILE).encode(pa.array(cases))
    for text, got in zip(cases, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == fresh.encode(text or "", add_special_tokens=False).ids
    assert fresh.encode(cases[0], add_special_tokens=False).ids == [505, 220, 50256, 734]


def test_a_worker_gives_memory_back_after_its_task():
    made = []

    class Docs:
        def mapInArrow(self, work, schema):
            made.append(work)

    tokenids._coded(Docs(), public_tokenizers.path("byte_bpe_50k.json"), 2)
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(True)

    batch = pa.RecordBatch.from_pydict({"part": [0], "id": [1], "text": ["one two"]})
    real, pa.default_memory_pool = pa.default_memory_pool, Pool
    try:
        assert sum(out.num_rows for out in made[0](iter([batch]))) == 1
    finally:
        pa.default_memory_pool = real
    assert freed == [True]


def test_pages_and_row_groups_hold_few_blocks(spark, tmp_path):
    """A block is one large row; a writer and a reader hold a page and a row group whole."""
    import pyarrow.parquet as pq

    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=500_000))
    docs = spark.createDataFrame([(None, text[i:] + text[:i]) for i in range(40)], "doc_id long, text string")
    tokenids.write_ids(docs, f"{tmp_path}/ids", FILE, 2)
    assert tokenids.read_ids(spark, f"{tmp_path}/ids").count() == 40
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "ids/blocks").rglob("*.parquet")]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 10 << 20
    assert max(g.total_byte_size for g in groups) < 6 << 20
