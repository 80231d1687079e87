"""Tables and fixtures of the tests in this folder."""

from __future__ import annotations

import pytest

from kpiloom.llm.common import documents

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """Ids and texts of the smallest documents table, for brute-force comparisons."""
    return {r.doc_id: r.text for r in documents(spark, DATA).select("doc_id", "text").collect()}


#: Rows that every operator must take: nulls, empty, blank, repeated, long.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two three"),
    (4, "one two three"),
    (None, "one two three"),
    (None, None),
    (5, "word " * 30_000),
    (6, "x" * 100_000),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows, with columns whose names the operators use inside."""
    rows = [(i, t, None, None, 1, 2, "s") for i, t in EDGE]
    schema = "doc_id long, text string, lang string, source string, key int, fp int, spans string"
    return spark.createDataFrame(rows, schema)
