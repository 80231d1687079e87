"""The automaton against regular expressions, and the query against its SQL."""

from __future__ import annotations

import random
import re

from compare import connect, differences, oracle_table
from llm_cases import DATA

from kpiloom.llm import queries, urls


def as_regex(glob):
    parts = {"**": ".*", "*": "[^/]*", "?": "."}
    return "".join(parts.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]", glob))


def test_automaton_matches_as_regular_expressions_do():
    rng = random.Random(4)
    globs = ["".join(rng.choices(["a", "b", "/", ".", "*", "**", "?"], k=rng.randint(0, 9))) for _ in range(90)]
    globs += ["x" * 130 + "*y", "**", "*"]
    texts = ["".join(rng.choices("ab/.", k=rng.randint(0, 14))) for _ in range(400)] + ["x" * 130 + "zzy", ""]
    automaton = urls.Automaton(globs)
    assert automaton.words > 5
    got = automaton.matches([t.encode() for t in texts])
    for text, row in zip(texts, got):
        want = [bool(re.fullmatch(as_regex(g), text, re.S)) for g in globs]
        assert row.tolist() == want


def test_query_matches_sql(spark):
    result = queries.op9_url_filter(spark, DATA).toArrow()
    assert differences(result, oracle_table(connect(DATA), queries.ORACLE_SQL["op9_url_filter"])) == []


def test_edge_rows(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/x": ("", "", None, "allow"),
        "http://A.Example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://subnet/": ("subnet", "/", None, "allow"),
        "http://x.com/a.net/": ("x.com", "/a.net/", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://w.org/fr/?a#b": ("w.org", "/fr/", "org/fr/", "allow"),
        "http://\u0130.com?/login": ("\u0130.com", "", None, "allow"),
        "http://\u00c9.com/login/é\nx": ("\u00c9.com", "/login/é\nx", None, "block"),
        "http://a.com/" + "y" * 20_000 + ".zip": ("a.com", "/" + "y" * 20_000 + ".zip", None, "block"),
    }
    rows = [(i, u, "h", 1) for i, u in enumerate([*cases, None])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, tier int")
    from pyspark.sql import functions as F

    got = urls.judge(pages, queries.URL_RULES, "allow", "page_id").orderBy("page_id").collect()
    want = [*cases.values(), cases[None]]
    assert [(r.host, r.path, r.rule if r.tier == 1 else None, r.verdict) for r in got] == want
    assert urls.judge(pages.where(F.lit(False)), queries.URL_RULES, "allow", "page_id").collect() == []
    assert {r.verdict for r in urls.judge(pages, [], "review", "page_id").collect()} == {"review"}
