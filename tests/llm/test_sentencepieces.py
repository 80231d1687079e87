"""SentencePiece ids and texts against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm_cases import DATA, EDGE, edge, texts  # noqa: F401

from kpiloom.llm import queries, sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def expected(text):
    ids = sentencepieces.codec(MODEL).library.encode(text or "", add_bos=True, add_eos=True)
    return ids, sentencepieces.codec(MODEL).library.decode(ids)


def test_hard_texts_in_one_chunk():
    rng = random.Random(3)
    parts = ["cor", "talk", "the", "ing", " ", "  ", "\n", "neutr", "a", "é", "😀", "▁", "\x00", "\x01", "<s>", "一"]
    cases = ["", None, " ", "ab" * 3000, "cor" * 900, "▁▁ a", " " * 40, "<0x41>", "</s>"]
    cases += ["".join(rng.choices(parts, k=rng.randint(0, 200))) for _ in range(300)]
    codec = sentencepieces.codec(MODEL)
    ids, sizes = codec.framed(pa.array(cases))
    decoded, ends = codec.decode(ids, sizes), np.cumsum(sizes)
    for text, size, end, back in zip(cases, sizes, ends, decoded):
        assert (ids[end - size : end].tolist(), back) == expected(text)


def test_ids_that_no_text_has_decode_as_in_the_library():
    codec = sentencepieces.codec(MODEL)
    ids = [1, codec.bytes[0xFF], codec.bytes[0xC3], 500, 0, 600, 2]
    assert codec.decode(np.array(ids), np.array([len(ids)])) == [codec.library.decode(ids)]


def test_query_against_the_library(spark, texts):  # noqa: F811
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_sentencepiece(spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids, back = expected(text)
        raw = np.array(ids, dtype="<u4").tobytes()
        digests = [hashlib.sha256(x).hexdigest() for x in (raw, back.encode())]
        assert got[i] == (len(ids), *digests)


def test_edge_rows(spark, edge):  # noqa: F811
    got = sentencepieces.encode_decode(edge, MODEL, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t in EDGE)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert sentencepieces.encode_decode(edge.limit(0), MODEL, ["doc_id"]).collect() == []
