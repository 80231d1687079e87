"""Counts and verdicts against the definitions, in plain Python and numpy."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from llm_cases import DATA, EDGE, edge  # noqa: F401
from pyspark.sql import functions as F

from kpiloom.llm import quality, queries
from kpiloom.llm.common import documents


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), [0] * len(words)
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered[i : i + 5] = [1] * 5
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": sum(covered),
    }


def moments(x):
    return x.mean(0), np.cov(x.T, bias=True)


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def plain_fit(x):
    """Mean and covariance of one group, row by row instead of by cells."""
    floor = np.diag(np.array(quality.FLOOR) ** 2)
    middle = np.sort(x, 0)[(len(x) - 1) // 2]
    spread = 1.4826 * np.sort(abs(x - middle), 0)[(len(x) - 1) // 2]
    best = None
    for mean, cov in ((middle, np.diag(spread**2)), moments(x)):
        for _ in range(quality.STEPS):
            d = np.round(distances(x, mean, cov + floor), 9)
            order = np.lexsort((*x.T[::-1], d))
            need = int(np.floor(quality.CORE * len(x))) + 1
            last = order[need - 1]
            near = order[: need]
            same = (x == x[last]).all(1)
            near = np.union1d(near, np.flatnonzero(same))
            mean, cov = moments(x[near])
        det = np.linalg.det(cov + floor)
        if best is None or det < best[0] - 1e-9:
            best = det, mean, cov + floor
    _, mean, cov = best
    limit, again = quality._consistency(0.975)
    inner = x[distances(x, mean, cov * quality._consistency(quality.CORE)[1]) <= limit]
    mean, cov = moments(inner)
    return mean, again * (cov + floor)


def plain_kept(rows):
    """rows: (lang, source, counts)."""
    vectors = []
    for lang, source, c in rows:
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        vectors.append(
            None
            if failed
            else np.floor(
                100
                * np.array(
                    [
                        np.log(c["word_chars"] / c["n_words"]),
                        *np.sqrt([c["n_symbols"] / c["word_chars"], c["n_dup_lines"] / c["n_lines"], c["n_repeat_words"] / c["n_words"]]),
                    ]
                )
                + 0.5
            )
        )
    good = [i for i, v in enumerate(vectors) if v is not None]
    kept, fits = [False] * len(rows), {}
    for i in good:
        for level in ((rows[i][0], rows[i][1]), (rows[i][0],), ()):
            own = [j for j in good if rows[j][: len(level)] == level]
            if len(own) >= quality.FEWEST or level == ():
                if level not in fits:
                    fits[level] = plain_fit(np.array([vectors[j] for j in own]))
                kept[i] = bool(distances(vectors[i][None], *fits[level])[0] <= quality.CUTOFF)
                break
    return kept


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = documents(spark, folder).select("doc_id", "lang", "source", "text").collect()
    found = [(r.lang, r.source, plain_counts(r.text)) for r in rows]
    kept = plain_kept(found)
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, folder).collect()}
    assert len(got) == len(rows)
    for r, (_, _, c), k in zip(rows, found, kept):
        mine = got[r.doc_id]
        assert all(mine[n] == c[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert mine.base_failed == (c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"])
        assert mine.kept == k
    assert 0 < sum(not k for k in kept) < len(kept)


def test_labelled_documents(spark):
    """Nearly all documents of good quality stay, and most of the bad ones go."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    joined = queries.op10_quality_rules(spark, folder).join(labels, "doc_id").where("NOT base_failed")
    share = {r.quality: r.share for r in joined.groupBy("quality").agg(F.avg(joined.kept.cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_passing_rows_keep_their_columns(spark):
    docs = documents(spark, DATA)
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    passed = quality.passing(docs)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == kept


def test_edge_rows(spark, edge):  # noqa: F811
    got = quality.judge(edge).collect()
    want = sorted(str((i, c["n_words"], c["word_chars"], c["n_repeat_words"])) for i, t in EDGE for c in [plain_counts(t)])
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_repeat_words)) for r in got) == want
    assert all(r.base_failed and not r.kept for r in got)
    assert quality.passing(edge).columns == edge.columns and quality.passing(edge).count() == 0
    assert quality.judge(edge.limit(0)).collect() == []


def test_a_constant_group_rejects_only_what_differs(spark):
    rows = [(i, " ".join(f"w{i}x{k:03}" for k in range(40)), "en", None) for i in range(10, 99)]
    rows += [(0, " ".join(f"{k}#$%&<>" for k in range(100, 140)), "en", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in quality.judge(frame).where("NOT kept").collect()] == [0]


def test_junk_of_two_fifths_of_a_source_is_rejected(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1000):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(60)]
        if i < 400:
            words = [w[:3] + "#$%"[: rng.integers(1, 4)] for w in words]
        rows.append((i, " ".join(words), "en", "hot"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(frame).where("kept").collect()}
    assert sum(i < 400 for i in kept) < 8 and sum(i >= 400 for i in kept) > 594
