"""Components by exact shingle similarity, against all pairs in plain Python; trees against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGE, edge  # noqa: F401
from pyspark.sql import functions as F

from kpiloom.llm import sigtree
from kpiloom.llm.common import documents


def plain_set(text, width=4):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain_groups(rows, width=4, percent=85):
    """Set size and smallest id of each row's component."""
    sets = [plain_set(t, width) for _, t in rows]
    head = list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(i, j) for own in by_shingle.values() for j in own for i in own if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            head[top(j)] = top(i)
    lowest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            lowest[top(i)] = min(k, lowest.get(top(i), k))
    return [(len(s), k if not s else lowest.get(top(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sigtree.similar_groups(frame).collect()))
    assert got == sorted((k, n, c) for (k, _), (n, c) in zip(rows, plain_groups(rows)))
    return got


def test_against_all_pairs(spark):
    rows = [tuple(r) for r in documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert len({c for *_, c in got}) < len({t for _, t in rows})


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("leaves", [1024, 7])
def test_groups_of_near_copies_and_a_common_passage(spark, monkeypatch, leaves):
    monkeypatch.setattr(sigtree, "LEAVES", leaves)
    rng = random.Random(8)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(rng.choice((20, 60, 200)))]
        rows += [(0, edited(base, rng, rng.randrange(5))) for _ in range(25)]
    rows += [(0, passage + " " + " ".join(f"own{rng.random()}" for _ in range(rng.choice((3, 6, 9, 40))))) for _ in range(120)]
    rows += [(0, t) for t in ("a b c d", "a b c d e", "A b c d", "a b", "A  b", "", " \n", None)]
    rng.shuffle(rows)
    got = check(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    assert len({c for *_, c in got}) > 6


def test_candidates_of_a_group_grow_with_its_members(spark, monkeypatch):
    """Pairs that are verified, of a group of near copies of which most are not similar to each other."""
    checked = []
    verified = sigtree._verified

    def counted(docs, pairs, *rest):
        checked[-1] += pairs.count()
        return verified(docs, pairs, *rest)

    monkeypatch.setattr(sigtree, "_verified", counted)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(75)]
    for count in (150, 600):
        checked.append(0)
        rows = [(i, edited(base, rng, 1)) for i in range(count)]
        check(spark, rows)
        assert checked[-1] < 9 * count, checked


def test_a_walk_keeps_every_similar_pair():
    rng = random.Random(2)
    sets = []
    for _ in range(40):
        base = [rng.getrandbits(64) for _ in range(rng.choice((5, 40, 70, 300)))]
        for _ in range(rng.choice((1, 3, 9))):
            own = [x if rng.random() > 0.03 else rng.getrandbits(64) for x in base]
            sets.append(np.unique(np.array(own, dtype=np.uint64)))
    nodes = np.arange(len(sets))
    similar = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))
    }
    assert len(similar) > 20
    for heads in (nodes, nodes % 7):
        sizes = np.array([len(s) for s in sets])
        bits = pa.array([sigtree.bitmap(s).tobytes() for s in sets])
        whole = sigtree.Members(nodes, sizes, heads, nodes, bits)
        found = {(min(p), max(p)) for p in zip(*map(list, sigtree.candidates(whole, whole, 85)[:2]))}
        want = {(i, j) for i, j in similar if heads[i] != heads[j]}
        assert want <= found and len(found) < 2 * len(similar) + 20
        assert all(heads[i] != heads[j] for i, j in found)
        half = nodes % 2 == 0
        parts = [sigtree.Members(nodes[h], sizes[h], heads[h], nodes[h], bits.filter(pa.array(h))) for h in (half, ~half)]
        across = {(min(p), max(p)) for p in zip(*map(list, sigtree.candidates(*parts, 85)[:2]))}
        assert {(i, j) for i, j in want if (i + j) % 2} <= across


def test_small_units_together_as_one_by_one():
    rng = random.Random(4)
    sets, units = [], []
    for unit in range(60):
        base = [rng.getrandbits(64) for _ in range(rng.choice((5, 40, 63, 66, 300)))]
        for _ in range(rng.randrange(1, sigtree.CHILDREN + 1)):
            own = [x for x in base if rng.random() > 0.04]
            sets.append(np.unique(np.array([*own, rng.getrandbits(64)], dtype=np.uint64)))
            units.append(unit)
    units, nodes, sizes = np.array(units), np.arange(len(sets)), np.array([len(s) for s in sets])
    heads, bits = nodes // 2, pa.array([sigtree.bitmap(s).tobytes() for s in sets])
    p, q, alike = sigtree.leaf_pairs(units, sizes, heads, nodes // 3, bits, 85)
    got = {(min(x), max(x)) for x in zip(p.tolist(), q.tolist())}
    want = set()
    for unit in range(60):
        at = np.flatnonzero(units == unit)
        own = sigtree.Members(nodes[at], sizes[at], heads[at], nodes[at] // 3, bits.take(pa.array(at)))
        want |= {(min(x), max(x)) for x in zip(*(x.tolist() for x in sigtree.candidates(own, own, 85)[:2]))}
    assert got == want and len(want) > 30
    assert len(alike) == len(got) and alike.min() >= 85 / 185 and alike.max() <= 0.5


def test_given_takes_the_likeliest_and_the_smallest_partners():
    units, alike = np.array([0, 0, 0, 0, 0, 1]), np.array([0.46, 0.48, 0.47, 0.5, 0.46, 0.5])
    a, b = np.array([5, 5, 5, 8, 9, 5]), np.array([3, 2, 4, 9, 4, 1])
    got = list(zip(*(x.tolist() for x in sigtree.given(units, a, b, alike, 1))))
    assert got == [(0, 5, 3, False), (0, 5, 2, False), (0, 5, 4, False), (0, 9, 8, False), (0, 9, 4, False), (1, 5, 1, False)]
    a, b = np.array([1, 2, 3, 2, 3, 3]), np.array([0, 0, 0, 1, 1, 2])
    alike = np.array([0.5, 0.49, 0.48, 0.47, 0.461, 0.46])
    got = list(zip(*(x.tolist() for x in sigtree.given(units * 0, a, b, alike, 1))))
    assert got == [(0, 1, 0, True), (0, 2, 0, True), (0, 3, 0, True)]


def test_edge_rows(spark, edge):  # noqa: F811
    got = sigtree.similar_groups(edge).collect()
    want = [(k, n, c) for (k, _), (n, c) in zip(EDGE, plain_groups(EDGE))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sigtree.similar_groups(edge.limit(0)).collect() == []
    only_null = edge.where(F.col("doc_id").isNull())
    assert {r.component_id for r in sigtree.similar_groups(only_null).collect()} == {None}


def test_large_copies_go_when_the_blocks_are_made(spark, tmp_path, monkeypatch):
    """Neither prefixes, bitmaps of all rows nor the sets of pairs stay beside the result."""
    from kpiloom.sources import stage

    made = []
    monkeypatch.setattr(stage, "new_path", lambda _: made.append(str(tmp_path / str(len(made)))) or made[-1])
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words), "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = sigtree.similar_groups(df)
    left = [spark.read.parquet(p).columns for p in made if (tmp_path / p).exists()]
    assert sorted((r.doc_id, r.component_id) for r in groups.collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    assert len(left) < len(made)
    assert not any({"prefix", "shingles"} & set(columns) for columns in left)
