"""Collocations against a plain count and DuckDB, tries against a dictionary."""

from __future__ import annotations

import re
from collections import Counter

import compare
import numpy as np
import pytest
from llm_cases import DATA, edge  # noqa: F401

from kpiloom.llm import phrases, queries


def plain(rows, least, longest, top):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 100 * f[lang, p[i : i + k]]:
                    inside.add((lang, p[i : i + k]))
    out = []
    for lang in totals:
        rows = []
        for (own, p), a in found.items():
            if own == lang and (own, p) not in inside:
                cuts = [(1000 * a * totals[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


ROWS = [
    ("en", "New York city, new york City! the new york\tcity hall; york. the new deal"),
    ("en", "the city the city the city the city"),
    ("und", "a a a a a a. b a a"),
    (None, "a a b\nÀ b À b à b. \x1c x \x1c x \x00 x"),
    ("de", ""),
    ("de", None),
    ("de", " \t.,"),
    ("fr", "x " * 3000),
    ("en", "New York city, new york City! the new york\tcity hall; york. the new deal"),
]


@pytest.mark.parametrize("shard, buckets, held", [(1 << 18, 1 << 22, 8 << 20), (4, 1 << 16, 10)])
def test_against_a_plain_count(spark, monkeypatch, shard, buckets, held):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "BUCKETS", buckets)
    monkeypatch.setattr(phrases, "HELD", held)
    docs = spark.createDataFrame(ROWS, "lang string, text string").repartition(3)
    for least, longest, top in ((2, 5, 2000), (3, 3, 2)):
        got = sorted(map(tuple, phrases.collocations(docs, least, longest, top).collect()))
        assert got == plain(ROWS, least, longest, top)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op12_phrases(spark, folder).toArrow()
    assert not compare.differences(got, compare.oracle_table(compare.connect(folder), queries.OP12_SQL))
    assert got.num_rows > 20


def test_tries_count_as_a_dictionary_does():
    rng = np.random.default_rng(3)
    for codes, count in ((3, 20), (40, 500), (2000, 3000)):
        sequences = np.unique((codes * rng.random((count, 3)) ** 3).astype(np.int32) + 1, axis=0)
        sequences[:, 0] = codes + 1
        sequences = np.unique(sequences, axis=0)
        trie = phrases.DoubleArray(rng.permutation(sequences, axis=0))
        text = (codes * rng.random(5000) ** 3).astype(np.int64) + rng.integers(0, 2, 5000)
        got = trie.count(text, codes + 1, 2, len(sequences))
        seen = Counter(zip(text[:-1].tolist(), text[1:].tolist()))
        order = {tuple(s[1:]): None for s in sequences.tolist()}
        assert got.sum() == sum(seen[p] for p in order)
        assert len(trie.base) < 8 * (codes + len(sequences)) + 20_000


def test_a_shard_is_counted_with_little_on_the_driver(spark):
    """What is sent to the tasks has a few bytes for each word of a phrase, not an object."""
    import pyarrow as pa
    from pyspark import cloudpickle

    words = [[f"word{i % 5000:040d}", f"word{i * 7 % 4999:040d}", f"word{i % 4998:040d}"] for i in range(60_000)]
    shard = pa.table({"lang": pa.array(["en", "de"] * 30_000), "words": pa.array(words, pa.list_(pa.string()))})
    sent = []

    class Chunks:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            sent.append(len(cloudpickle.dumps(work)))
            return spark.createDataFrame([], schema)

    assert phrases._shard_counts(Chunks(), shard, 3).collect() == []
    assert sent[0] < 8_000_000


def test_a_task_writes_its_counts_as_a_few_rows(spark):
    """Not a row for each phrase: every task meets most of them."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([("en", " ".join(words))] * 4, "lang string, text string").repartition(4)
    shard = pa.table({"lang": ["en"] * 299, "words": [list(x) for x in zip(words, words[1:])]})
    made = []

    class Frame:
        def __init__(self, df):
            self.df = df

        def select(self, *columns):
            return Frame(self.df.select(*columns))

        def mapInArrow(self, work, schema):
            out = self.df.mapInArrow(work, schema)
            made.append(out.count())
            return out

    counts = phrases._shard_counts(Frame(docs.mapInArrow(phrases._chunks, phrases.CHUNK)), shard, 2).collect()
    assert {(*r.words, r.f) for r in counts} == {(*x, 4) for x in zip(words, words[1:])} and len(counts) == 299
    assert made[0] <= 4


def test_chunks_are_small():
    """A task is sent all its chunks in one batch."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    text = " ".join(f"word{x}" for x in (3000 * rng.random(200_000) ** 3).astype(int))
    batch = pa.record_batch({"lang": ["en"] * 2, "text": [text, None]})
    (chunk,) = phrases._chunks(iter([batch]))
    assert chunk.column("ids")[0].as_buffer().size < 3 * 200_000
    ((lang, words, n, ids),) = phrases._rows(iter([chunk]), "words", "n", "ids")
    assert " ".join(words[i].decode() for i in ids if i >= 0) == text and lang == "en" and n.sum() == 200_000


def test_edge_rows(spark, edge):  # noqa: F811
    got = {(r.phrase, r.a, r.n) for r in phrases.collocations(edge, least=3).collect()}
    words = 3 * 3 + 30_000 + 1
    assert got == {("one two three", 3, words), ("word word word word word", 29_996, words), *(
        (" ".join(["word"] * k), 30_001 - k, words) for k in (2, 3, 4)
    )}
    assert phrases.collocations(edge.limit(0)).collect() == []
    assert phrases.collocations(edge).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_candidates_leave_a_task_as_a_few_rows(spark, monkeypatch):
    """Not a row for each phrase and task: those would grow with the square of the input."""
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([("en", " ".join(words))] * 8, "lang string, text string").repartition(8)
    monkeypatch.setattr(phrases, "FEWEST_PIECES", 4)
    chunks = docs.mapInArrow(phrases._chunks, phrases.CHUNK).localCheckpoint()
    level = spark.createDataFrame([("en", [w]) for w in words], "lang string, words array<string>")
    made = []
    real = type(docs).mapInArrow

    def counted(self, work, schema):
        out = real(self, work, schema)
        if "marks" in self.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    found = phrases._candidates(chunks, level, 2, 8, 4).collect()
    assert sorted(tuple(r.words) for r in found) == sorted(zip(words, words[1:]))
    assert len(made) == 2 and made[1] <= 8 * 4


def test_pairs_of_equal_hash_are_told_apart():
    import pyarrow as pa

    a, b = np.array([5, 7, 5, 9], np.uint64), np.array([1, 2, 1, 2], np.uint64)
    made = list(phrases._pairs_out(phrases._pair_counts(a, b, np.array([1, 1, 1, 2])), 64))
    assert sum(len(x) for x in made) == len({int(h) >> 58 for h in phrases._pair_counts(a, b, np.ones(4, np.int64))[0]})
    one = [x.set_column(0, "piece", pa.array([0], pa.int32())) for x in made * 2]
    (out,) = phrases._frequent_pairs(iter(one), 4)
    assert sorted(zip(*out.to_pydict().values())) == [(5, 1), (9, 2)]


def test_candidates_by_brute_force_with_few_held(spark, monkeypatch):
    """Places are counted and written out many times in a task."""
    monkeypatch.setattr(phrases, "PLACES", 50)
    rng = np.random.default_rng(8)
    rows = [("en" if i % 3 else None, " ".join(f"v{x}" for x in (30 * rng.random(200) ** 2).astype(int))) for i in range(12)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(map(tuple, phrases.collocations(docs, 3, 5, 300).collect())) == plain(rows, 3, 5, 300)
