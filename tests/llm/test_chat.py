"""Round trips of the chat grammar, and the query against its SQL."""

from __future__ import annotations

import random

from compare import connect, differences, oracle_table
from llm_cases import DATA
from pyspark.sql import functions as F

from kpiloom.llm import chat, queries


def test_query_matches_sql(spark):
    result = queries.op1_chat_format(spark, DATA).toArrow()
    assert differences(result, oracle_table(connect(DATA), queries.ORACLE_SQL["op1_chat_format"])) == []


def test_any_content_comes_back(spark):
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", "INST]", "/", "\n", "é😀", "", "ok ", "$1", "\\E"]
    text = lambda: "".join(rng.choices(parts, k=rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(300) for t in range(rng.randint(1, 5))]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


    got = chat.format_chats(frame).select(
        "*", chat.parsed(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    for r in got.collect():
        own = sorted(x[1:] for x in rows if x[0] == r.conv_id)
        assert r.round_trip and [tuple(t) for t in r.turns] == [x[1:] for x in own]
        assert r.loss == "".join(x[2] for x in own if x[1] == "assistant")


def test_plain_content_is_not_escaped(spark, frame):
    made = chat.format_chats(frame("conv_id long, turn int, role string, text string", (1, 0, "user", "a [b] <c>")))
    assert made.first().formatted == "<s>user[INST]a [b] <c>[/INST]</s>"


def test_text_outside_the_grammar(spark):


    bad = ["x", "<s>a[INST]b", "<s>a[INST]b[/INST]", "<s>ab[/INST]</s>", "a[INST]b[/INST]</s>", "<s>a[INST]b[/INST]c[/INST]</s>", "<s>[/INST]</s>"]
    frame = spark.createDataFrame([(b,) for b in bad], "t string")
    for (turns,) in frame.select(chat.parsed(F.col("t"))).collect():
        assert turns is None or None in turns


def test_edge_rows(spark, frame):
    rows = [(1, None, None, None), (1, None, None, None), (None, 1, "user", "a"), (None, 0, "assistant", "b"), (2, 3, "assistant", "x" * 200_000), (3, 1, "assistant", ""), (3, 1, "assistant", "")]
    table = frame("conv_id long, turn int, role string, text string", *rows)


    got = {r.conv_id: r for r in chat.format_chats(table.withColumn("formatted", F.lit(1))).collect()}
    assert got[1].formatted == "<s>[INST][/INST]</s>" * 2 and got[1].loss_spans == []
    assert got[None].formatted == "<s>assistant[INST]b[/INST]</s><s>user[INST]a[/INST]</s>"
    assert len(got[2].formatted) == 200_029 and len(got[3].loss_spans) == 2
    assert all(r.round_trip for r in got.values())
    assert chat.format_chats(table.limit(0)).collect() == []
