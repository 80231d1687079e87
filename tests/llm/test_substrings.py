"""Window removal against the definition, window by window."""

from __future__ import annotations

import hashlib
import random

import pytest
from llm_cases import DATA, edge, texts  # noqa: F401

from kpiloom.llm import queries, substrings


def plain(rows, width=13):
    """(id, words, covered) of every row."""
    split = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    lowest = {}
    for i, words in split:
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if i is not None:
                lowest[window] = min(i, lowest.get(window, i))
    for i, words in split:
        covered = [False] * len(words)
        for k in range(len(words) - width + 1):
            if i is not None and lowest[tuple(words[k : k + width])] < i:
                covered[k : k + width] = [True] * width
        yield i, words, covered


def test_query_against_brute_force(spark, texts):  # noqa: F811
    want = {
        i: (len(w), sum(c), hashlib.sha256(" ".join(x for x, y in zip(w, c) if not y).encode()).hexdigest())
        for i, w, c in plain(texts.items())
    }
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_substring_dedup(spark, DATA).collect()}
    assert got == want
    assert any(removed for _, removed, _ in want.values())


@pytest.mark.parametrize("together", [1, 50, 1 << 22])
def test_small_windows_many_cells(spark, monkeypatch, together):
    """Few words, so that windows repeat everywhere, in unordered and distant ids."""
    monkeypatch.setattr(substrings, "CELL_DOCUMENTS", 3)
    rng = random.Random(5)
    rows = [(rng.randint(-9, 9) * 10**rng.randint(0, 15), " ".join(rng.choices("ab", k=rng.randint(0, 12)))) for _ in range(90)]
    rows += rows[:9] + [(None, "a b a b"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(
        (str(r.doc_id), r.n_words, r.n_removed, r.kept, str([tuple(x) for x in r.removed]))
        for r in substrings.remove_repeats(frame, width=4, together=together).collect()
    )
    want = []
    for i, words, covered in plain(rows, 4):
        runs, k = [], 0
        while k < len(words):
            end = k
            while end < len(words) and covered[end]:
                end += 1
            if end > k:
                runs.append((k, end))
            k = max(end, k + 1)
        kept = " ".join(w for w, c in zip(words, covered) if not c)
        want.append((str(i), len(words), sum(covered), kept, str(runs)))
    assert got == sorted(want)


def test_edge_rows(spark, edge):  # noqa: F811
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(edge).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 3, 0), (None, 3, 0), (None, 0, 0), (5, 30_000, 0), (6, 1, 0)}
    assert substrings.remove_repeats(edge.limit(0)).collect() == []
