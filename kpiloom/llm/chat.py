"""Chat formatting with a grammar that reads its own output back.

A conversation is a sequence of turns, each ``<s>`` role ``[INST]`` text ``[/INST]</s>``. The four
marks are the control strings. The parser cuts at marks and takes one backslash off each escaped
character. Rendering is a round trip: a turn is first rendered as it is and parsed; if other turns
come back than the one that went in (its text holds marks, or backslashes that the parser takes
off), role and text are escaped: a backslash is doubled, and one is put behind the first character
of each control string. The result is parsed again, and the whole conversation at the end;
``round_trip`` says that it came back identical.

The loss mask lists the places (code points) of the assistant's texts in the formatted text.

Only DataFrame functions run here. One shuffle brings the turns of a conversation together; a
conversation is one row of the result, as its formatted text is.

Defined results: turns are ordered by turn, then role and text, nulls first; null roles and texts
count as empty; repeated rows are turns of their own; null conversation ids make one conversation;
an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, HEAD, CLOSE, END)


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD), text, F.lit(CLOSE + END))


def parsed(formatted: Column) -> Column:
    """Turns (``role``, ``text``) of a formatted text; null stands for what the grammar does not have."""

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\Q" + HEAD + r"\E", -1)
        body = F.get(parts, F.lit(1))
        good = (F.size(parts) == 2) & F.startswith(piece, F.lit(OPEN)) & F.endswith(piece, F.lit(CLOSE))
        good &= F.length(piece) >= len(OPEN + HEAD + CLOSE)
        role = unescaped(F.substr(F.get(parts, F.lit(0)), F.lit(len(OPEN) + 1)))
        text = unescaped(F.left(body, F.length(body) - len(CLOSE)))
        clean = ~F.contains(F.left(body, F.length(body) - len(CLOSE)), F.lit(CLOSE))
        clean &= ~F.contains(F.substr(piece, F.lit(2)), F.lit(OPEN))
        return F.when(good & clean, F.struct(role.alias("role"), text.alias("text")))

    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    whole = F.endswith(formatted, F.lit(END)) | (formatted == "")
    return F.when(whole, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))


def format_chats(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: str = "assistant",
) -> DataFrame:
    """``conversation``, ``formatted``, ``loss_spans`` (``start``, ``end``) and ``round_trip``."""
    turns = df.select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain = rendered(F.col("role"), F.col("text"))
    safe = rendered(escaped(F.col("role")), escaped(F.col("text")))
    piece = F.when(parsed(plain).eqNullSafe(source), plain).otherwise(safe)
    turns = turns.withColumn("piece", piece).withColumn(
        "role_size", F.length(F.substring_index("piece", HEAD, 1)) + len(HEAD)
    )
    gathered = turns.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece", "role_size"))).alias("turns")
    )
    running = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda state, t: F.struct(
            (state["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["role"] == learned,
                F.array_append(
                    state["spans"],
                    F.struct(
                        (state["at"] + t["role_size"]).alias("start"),
                        (state["at"] + F.length(t["piece"]) - len(CLOSE + END)).alias("end"),
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    made = gathered.select(
        "conv",
        F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("source"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        running["spans"].alias("loss_spans"),
    )
    back = parsed(F.col("formatted")).eqNullSafe(F.col("source"))
    return made.select(
        F.col("conv").alias(conversation), "formatted", "loss_spans", back.alias("round_trip")
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, in order and with nothing between."""
    part = F.transform(
        spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))
    )
    return F.array_join(part, "")
