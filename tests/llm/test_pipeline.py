"""The pipeline against a brute-force run of its stages, and each stage on edge rows."""

from __future__ import annotations

import base64
import hashlib

import corpus_pipeline
import numpy as np
import pytest
import test_contamination
import test_neardup
import test_quality_rules
import test_secrets
import test_sentencepieces
from llm_cases import DATA, EDGE, edge  # noqa: F401

from kpiloom.llm import secrets
from kpiloom.llm.common import documents


def brute_force(rows, items):
    """rows: (doc_id, text, lang, source)."""
    found = [(lang, source, test_quality_rules.plain_counts(t)) for _, t, lang, source in rows]
    rows = [r for r, kept in zip(rows, test_quality_rules.plain_kept(found)) if kept]
    heads = test_neardup.plain_components([r[:2] for r in rows])
    rows = [r for r, head in zip(rows, heads) if r[0] == head]
    grams = {g for _, t in items for g in fives(t)}
    likely = [(i, t) for i, t, _, _ in rows if grams & fives(t)]
    bad = {i for i, _ in test_contamination.plain(likely, items)}
    rows = [r for r in rows if r[0] not in bad]
    for i, text, lang, source in rows:
        spans = [(a, b) for _, a, b in test_secrets.everything(text)]
        ids, back = test_sentencepieces.expected(secrets.masked(text or "", spans))
        raw = np.array(ids, dtype="<u4").tobytes()
        digests = [hashlib.sha256(x).hexdigest() for x in (raw, back.encode())]
        yield i, lang, source, len(ids), *digests, base64.b64encode(raw).decode()


def fives(text):
    words = test_contamination.contamination.words_of(text)
    return {tuple(words[j : j + 5]) for j in range(len(words) - 4)}


def test_run_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in documents(spark, folder).select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(brute_force(docs, items))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    assert 0 < len(want) < len(docs)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows(spark, edge, name, stage):  # noqa: F811
    from pyspark.sql import functions as F

    docs = edge.select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("n_chars"), "key", "fp")
    for some in (docs, docs.limit(0)):
        out = stage(spark, some, DATA)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) <= len(EDGE)
        if some is docs and name in ("decontamination", "secret_scan", "sentencepiece"):
            assert len(rows) == len(EDGE)
        if some is docs and name == "near_dedup":
            assert sorted(str(r.doc_id) for r in rows) == ["1", "4", "5", "6"]


def test_stages_leave_clean_documents_alone(spark):
    clean = " ".join(f"word{i} stands here" for i in range(40))
    rows = [(i, f"{clean} number{i * 7919} end{i}", "en", "a", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        assert {r.text for r in stage(spark, docs, DATA).collect()} == {r[1] for r in rows}, name
