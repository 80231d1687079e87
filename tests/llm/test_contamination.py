"""Matches against comparing every window with every item of its size."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from llm_cases import DATA, edge, texts  # noqa: F401

from kpiloom.llm import contamination, queries


def plain(docs, items, index_finds=lambda a, b: True):
    best = {}
    for i, text in docs:
        words = contamination.words_of(text)
        for item, item_text in items:
            own = contamination.words_of(item_text)
            k = min(5, len(own))
            grams = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
            if not own:
                continue
            for start in range(len(words) - len(own) + 1):
                window = words[start : start + len(own)]
                if not grams.keys() & {tuple(window[j : j + k]) for j in range(len(own) - k + 1)}:
                    continue
                seen = Counter(tuple(window[j : j + k]) for j in range(len(own) - k + 1))
                shared = sum((seen & grams).values())
                value = shared / sum((seen | grams).values())
                if value >= 0.8 and value > best.get((i, item), (0, 0))[0]:
                    best[i, item] = (value, start)
    return best


def result(df):
    return {(r.doc_id, r.item_id): (r.similarity, r.start) for r in df.collect()}


def test_query_against_brute_force(spark, texts):  # noqa: F811
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    tokens = {tuple(w[j : j + 5]) for _, t in items for w in [contamination.words_of(t)] for j in range(len(w) - 4)}
    likely = [
        (i, t)
        for i, t in texts.items()
        for w in [contamination.words_of(t)]
        if any(tuple(w[j : j + 5]) in tokens for j in range(len(w) - 4))
    ]
    got = result(queries.op6_decontamination(spark, DATA))
    assert got and got == plain(likely, items)


def test_changed_passages(spark):
    """Items with a changed end, case and punctuation are found; half an item is not."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(n, " ".join(word() for _ in range(size))) for n, size in enumerate([3, 5, 16, 16, 30, 59])]
    items += [(50, items[4][1]), (51, ""), (52, None)]
    docs = []
    for n, (_, text) in enumerate(items[:6]):
        w = text.split()
        around = [" ".join(word() for _ in range(20)) for _ in range(2)]
        docs.append((10 * n, f"{around[0]} {text.upper()}! {around[1]}"))
        docs.append((10 * n + 1, " ".join([around[0], *w[: -max(1, len(w) // 20)], word(), around[1]])))
        docs.append((10 * n + 2, " ".join([around[0], *w[: len(w) // 2], around[1]])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, want = result(contamination.contaminated(frame, bench)), plain(docs, items)
    assert got == want
    assert all((10 * n, n) in got for n in range(6)) and not any(i % 10 == 2 for i, _ in got)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    index = contamination.BlockIndex(marks, 15)
    probes = marks.copy()
    for row, flips in enumerate(rng.integers(0, 20, 300)):
        for bit in rng.choice(64, flips, replace=False):
            probes[row] ^= np.uint64(1) << np.uint64(bit)
    near = np.bitwise_count(probes[:, None] ^ marks[None, :]) <= 15
    got = set(zip(*(x.tolist() for x in index.within(probes))))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_small_blocks_of_items(spark, monkeypatch):
    items = [(n, f"alpha beta gamma delta {n} epsilon zeta") for n in range(7)]
    docs = spark.createDataFrame([(n, f"x {t} y") for n, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = result(contamination.contaminated(docs, bench))
    monkeypatch.setattr(contamination, "ITEMS", 2)
    assert result(contamination.contaminated(docs, bench)) == whole and len(whole) == 7


def test_edge_rows(spark, edge):  # noqa: F811
    items = [(1, "one two three"), (2, "word word word word word word"), (None, "ONE two, three"), (3, None), (4, "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.similarity) for r in contamination.contaminated(edge, bench).collect())
    assert got == Counter({(4, 1, 1.0): 2, (4, None, 1.0): 2, (None, 1, 1.0): 1, (None, None, 1.0): 1, (5, 2, 1.0): 1})
    assert contamination.contaminated(edge.limit(0), bench).collect() == []
    assert contamination.contaminated(edge, bench.limit(0)).collect() == []
