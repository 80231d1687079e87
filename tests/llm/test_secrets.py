"""Spans against plain patterns on code points, and links against comparing every two parts."""

from __future__ import annotations

import hashlib
import random
import re

from llm_cases import EDGE, edge  # noqa: F401

from kpiloom.llm import queries, secrets
from kpiloom.llm.common import documents

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base(text):
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


NAMED = re.compile(
    r"""(user(?:name)?|login|account|(?:client|access_key|key)_?id)["']?\x20*[:=]\x20*["']?([a-z0-9_.@-]{3,})""", re.I | re.A
)
IDS, SECRETS = {"access", "pair_id"}, {"assign", "hex", "pair_secret"}


def everything(text):
    """Strong spans, and weak candidates whose complements are near: each two parts are compared."""
    text = text or ""
    strong = base(text)
    named = [m.span() for m in NAMED.finditer(text)]
    weak = [("pair_id", *s) for s in named]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        kinds = {("a" <= c <= "z", "A" <= c <= "Z", c.isdigit()) for c in m[0]}
        if all(any(k[i] for k in kinds) for i in range(3)) and not any(a < m.end() and m.start() < b for a, b in named):
            weak.append(("pair_secret", *m.span()))
    weak += [("endpoint", *m.span()) for m in re.finditer(r"""[a-zA-Z][a-zA-Z0-9+.-]*://[^\x20\t-\r"'<>]+""", text)]
    weak = [w for w in weak if not any(a < w[2] and w[1] < b for _, a, b in strong)]
    parts = sorted(strong + weak, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    gaps = [m.span() for m in re.finditer(r"\n(?:[ \t\r]*\n)+", text)]
    edges = [0, *(b for _, b in gaps), len(text) + 1]
    paragraphs = [[p for p in parts if a <= p[1] < b] for a, b in zip(edges, edges[1:])]
    kept, run = [], []
    for own in [*paragraphs, []]:
        if own:
            run += own
            continue
        ids, hidden = (any(k in roles for k, _, _ in run) for roles in (IDS, SECRETS))
        need = {"pair_id": hidden, "pair_secret": ids, "endpoint": ids and hidden}
        kept += [p for p in run if need.get(p[0], True)]
        run = []
    return kept


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def expected(text):
    own = base(text)
    count = [sum(k == kind for k, _, _ in own) for kind in secrets.BASE_KINDS]
    return (*count, hashlib.sha256(line(own).encode()).hexdigest(), line(everything(text)))


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_secret_scan(spark, folder).collect()}
    want = {r.doc_id: expected(r.text) for r in documents(spark, folder).collect()}
    assert got == want
    assert sum(w[0] for w in want.values()) and sum(w[2] for w in want.values())


def test_linked_parts(spark):
    rng = random.Random(6)
    mixed = lambda: "".join(rng.choices("abcXYZ019", k=rng.choice([12, 24, 40])))
    bits = [
        lambda: f"token = '{mixed()}'",
        lambda: f"API_KEY:{mixed()}",
        lambda: "AKIA" + "".join(rng.choices("ABCD0123", k=rng.choice([9, 16]))),
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([20, 30]))),
        lambda: f"user = {mixed()[:5]}",
        lambda: f"client_id: {mixed()[:5]}",
        mixed,
        lambda: "https://db.example.com/x",
        lambda: "é\u0130ſecret: abcdef ",
        lambda: "\n\n",
        lambda: "\n\n lorem \n \n",
        lambda: "token: token=abcdef",
        lambda: " lorem ipsum" * rng.choice([1, 15, 40]),
    ]
    rows = [(i, " ".join(rng.choice(bits)() for _ in range(rng.randint(1, 25)))) for i in range(250)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
    weak = 0
    for i, text in rows:
        spans = [(s.kind, s.start, s.end) for s in got[i].spans]
        assert line(spans) == line(everything(text))
        assert line((s.kind, s.start, s.end) for s in got[i].base) == line(base(text))
        weak += len(got[i].spans) - len(got[i].base)
    assert weak > 50


def test_scopes(spark):
    secret, far = "aB3" * 8, " lorem" * 200
    texts = [
        f"user = bob\n\nkey {secret}",  # over a blank line
        f"user = bob{far} {secret}",  # at any distance
        f"user = bob\n\nlorem\n\n{secret}",  # a paragraph without a part between them
        f"user={secret}==",  # an identifier's value is no secret
        f"{secret} https://a.b/c",
        f"{secret}\n\nhttps://a.b/c\n\nuser = bob",
        "user = bob\n" * 3000 + secret,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(frame).collect()}
    assert got == {
        0: ["pair_id", "pair_secret"],
        1: ["pair_id", "pair_secret"],
        2: [],
        3: [],
        4: [],
        5: ["pair_secret", "endpoint", "pair_id"],
        6: ["pair_id"] * 3000 + ["pair_secret"],
    }


def test_redacted_texts_hold_no_span(spark):
    rows = [(1, "é user = bob password: 'hunter22' end", "n"), (1, "clean", None), (None, "token=abcdefgh x", "m"), (2, None, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = secrets.redacted(frame)
    assert out.columns == frame.columns
    assert sorted(map(str, out.collect())) == sorted(
        map(str, spark.createDataFrame([(1, "é [SECRET] [SECRET]' end", "n"), rows[1], (None, "[SECRET] x", "m"), rows[3]], frame.schema).collect())
    )


def test_edge_rows(spark, edge):  # noqa: F811
    got = sorted(str((r.doc_id, len(r.base), len(r.spans))) for r in secrets.find_secrets(edge).collect())
    assert got == sorted(str((i, 0, 0)) for i, _ in EDGE)
    assert sorted(map(str, secrets.redacted(edge).collect())) == sorted(map(str, edge.collect()))
    assert secrets.find_secrets(edge.limit(0)).collect() == []
    assert secrets.redacted(edge.limit(0)).collect() == []
