"""Spelling variants against all words in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from llm_cases import DATA, edge  # noqa: F401

from kpiloom.llm import queries, variants
from kpiloom.llm.common import documents


def plain_counts(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    shared = defaultdict(set)
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared[x].add(w)
    near = defaultdict(set)
    for own in shared.values():
        for a in own:
            near[a] |= {b for b in own if a != b and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(((-n[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_query_against_all_words(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in documents(spark, folder).select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(rows))
    got = sorted(map(tuple, queries.op13_spelling(spark, folder).collect()), key=str)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20


def test_all_words_of_few_letters(spark):
    """Many words of the same letters, with every kind of edit, and long chains of forms."""
    rng = random.Random(1)
    n = {"".join(rng.choice("abß") for _ in range(rng.choice((7, 8, 9)))): rng.choice((2, 30, 500, 9000)) for _ in range(400)}
    n |= {"chained" + "x" * k: 2 * 11**k for k in range(6)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted(map(tuple, variants.spelling_variants(words).collect()), key=str)
    assert got == plain_variants(n)
    assert {r[2] for r in got if r[0].startswith("chained")} == {"chainedxxxxx"}


def test_signatures_agree_for_near_words():
    rng = random.Random(7)
    for _ in range(300):
        word = "".join(rng.choice("abcdeéz") for _ in range(rng.randrange(7, 20)))
        at, new = rng.randrange(len(word)), rng.choice("abcdeéz")
        replaced, longer = word[:at] + new + word[at + 1 :], word[:at] + new + word[at:]
        a, b = variants.signatures([word, replaced], variants.PARTS, 2)
        assert (a == b).any()
        a, b = variants.signatures([word, longer], variants.FEW_PARTS, 1, [len(word)] * 2)
        assert (a == b).any()


def test_edge_rows(spark, edge):  # noqa: F811
    rows = [(None, "lantern Lantern"), (1, "lantern lanterns lanterns"), (2, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = plain_counts(rows)
    assert {tuple(r) for r in variants.word_counts(docs).collect()} == set(n.items())
    got = sorted(map(tuple, variants.spelling_variants(variants.word_counts(docs)).collect()), key=str)
    assert got == plain_variants(n)
    assert variants.word_counts(edge.limit(0)).collect() == []
    assert variants.spelling_variants(variants.word_counts(edge.limit(0))).collect() == []
    assert variants.spelling_variants(variants.word_counts(edge)).collect() == []
