"""SimHash links and components against comparing every pair."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from llm_cases import DATA, edge, texts  # noqa: F401

from kpiloom.llm import golay, queries, simhash
from kpiloom.llm.components import components


def plain_fingerprint(text):
    words = [w.lower() for w in (text or "").encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def plain_heads(marks):
    marks = sorted(set(marks))
    head = {m: m for m in marks}

    def top(m):
        while head[m] != m:
            m = head[m]
        return m

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                head[y] = x
    return {m: top(m) for m in marks}


def test_golay_keys_of_segments_one_bit_apart_meet():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 24, 4000)
    for flip in [0, *(1 << i for i in range(24))]:
        row_a, key_a = golay.codeword_keys(a)
        row_b, key_b = golay.codeword_keys(a ^ flip)
        assert np.isin(np.arange(4000), (row_a << 12 | key_a)[np.isin(row_a << 12 | key_a, row_b << 12 | key_b)] >> 12).all()


def family(size, bits, seed):
    """Fingerprints around one centre, a few bits from it."""
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    return {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(size)}


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(7)
    marks = family(400, 3, 1) | family(60, 4, 2) | {rng.getrandbits(64) for _ in range(300)} | {0, 1, 3, 7}
    signed = np.array(sorted(marks), dtype=np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(m,) for m in signed], "fp long")
    want = plain_heads(marks)
    groups = {}
    for mark, head in want.items():
        groups.setdefault(head, set()).add(mark)
    for crowd in (64, 3):
        got = {}
        for node, head in components(simhash.links(fps, crowd)).collect():
            got.setdefault(head, set()).add(node % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 500), (900, 901)], "x long, y long")
    got = {(r.node, r.head) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(201)} | {(900, 900), (901, 900)}


def test_query_against_brute_force(spark, texts):
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    heads = plain_heads(marks.values())
    lowest = {}
    for i, m in marks.items():
        lowest[heads[m]] = min(i, lowest.get(heads[m], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, DATA).collect()}
    assert got == {i: (f"{m:016x}", lowest[heads[m]]) for i, m in marks.items()}


def test_edge_rows(spark, edge):
    got = [tuple(r) for r in simhash.near_duplicates(edge).collect()]
    assert len(got) == edge.count()
    by_id = {}
    for i, fp, component in got:
        by_id.setdefault(i, set()).add((fp, component))
    assert {by_id[i].pop() for i in (1, 2, 3)} == {(0, 1)}
    assert len(by_id[4]) == 1 and next(iter(by_id[4]))[1] == 4
    assert {component for _, component in by_id[None]} == {1, 4}
    assert simhash.near_duplicates(edge.limit(0)).collect() == []
