"""Secret scans with multipart credential linking.

Strong spans are those of three fixed patterns: assigned secrets, access key identifiers and long hex
strings. Besides, three kinds of weak candidates are noted: assigned user or client identifiers
(``pair_id``), unnamed mixed-case strings with digits (``pair_secret``) and addresses of services
(``endpoint``). A weak candidate says little alone. It is reported only where the parts that
complement it are in the same scope: an identifier for a secret, a secret for an identifier, and both
for an endpoint. Strong spans are parts too: access keys are identifiers, assigned and hex strings
secrets. The value of an identifier is no secret of its own.

A scope is a run of paragraphs (between blank lines) of which each holds a part, strong or weak; a
paragraph without any ends it. So the entries of a configuration or key file link over blank lines
and at any distance, and unrelated passages of prose don't.

The texts are scanned once, and what was found is stored (it is small). The parts are linked by an
interval join: the scopes of a row are disjoint intervals, numbered as they come, each with the roles
that are present in it, and a candidate meets the one interval it lies in. So there are no pairs, and
the work is in proportion to the parts however many a scope has.

Defined results: null texts count as empty; places are code points, ends exclusive; equal rows each
have their spans; null ids stay null; very long texts are scanned whole; an empty table gives an
empty table. Only the key and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import text_chunks
from kpiloom.sources.stage import reliable_copy

#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "pair_id", "pair_secret", "endpoint")
BASE_KINDS = KINDS[:3]
#: Roles that parts of a kind have for others, and those that a weak kind needs.
ROLES = {"assign": "secret", "hex": "secret", "pair_secret": "secret", "access": "id", "pair_id": "id"}
NEEDS = {"pair_id": ("secret",), "pair_secret": ("id",), "endpoint": ("id", "secret")}
MASK = "[SECRET]"

# The patterns work on UTF-8 bytes; A-Z are lower-cased where letter case doesn't matter.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
NAMED = re.compile(
    rb"""(user(?:name)?|login|account|(?:client|access_key|key)_?id)["']?\x20*[:=]\x20*["']?([a-z0-9_.@-]{3,})"""
)
NAMED_WORDS = (b"user", b"login", b"account", b"id")
MIXED = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
MIXED_HAS = (re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"))
ENDPOINT = re.compile(rb"""[a-z][a-z0-9+.-]*://[^\s"'<>]+""")
SCOPE = re.compile(rb"\n(?:[\x20\t\r]*\n)+")


def scan(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, scope, start, end) of strong spans and weak candidates, by start and kind."""
    raw = text.encode()
    low = raw.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(raw)]
    weak = []
    if any(w in low for w in NAMED_WORDS):
        weak += [("pair_id", *m.span()) for m in NAMED.finditer(low)]
    named = [s[1:] for s in weak]
    for m in MIXED.finditer(raw):
        if all(has.search(m[0]) for has in MIXED_HAS):
            after = bisect_left(named, m.end(), key=lambda s: s[0])
            if not after or named[after - 1][1] <= m.start():  # else it is the identifier's value
                weak.append(("pair_secret", *m.span()))
    if b"://" in raw:
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(low)]
    if not found and not weak:
        return []
    strong = sorted(found, key=lambda s: s[1])
    reach, starts = np.maximum.accumulate([0, *(s[2] for s in strong)]), [s[1] for s in strong]
    for kind, start, end in weak:
        before = int(np.searchsorted(starts, end))
        if reach[before] <= start:  # what a strong span covers is no candidate
            found.append((kind, start, end))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    breaks = [m.start() for m in SCOPE.finditer(raw)]
    if len(raw) == len(text):
        points = None
    else:  # code points before each byte
        points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        points = np.append(points, len(text))
    out, scope, last = [], 0, 0
    for kind, start, end in found:
        paragraph = int(np.searchsorted(breaks, start))
        scope, last = scope + (paragraph > last + 1), paragraph
        place = (start, end) if points is None else (int(points[start]), int(points[end]))
        out.append((kind, scope, *place))
    return out


SPANS = "array<struct<kind:string,scope:int,start:int,end:int>>"


def _scanned(df: DataFrame, key: str, text: str) -> DataFrame:
    """``row``, ``key``, ``hash`` of the text, ``found``: stored, so that the row numbers stay."""
    picked = df.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")
    )
    kind = picked.schema["key"].dataType.simpleString()
    names = ("kind", "scope", "start", "end")
    struct = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in names[1:])]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            found = [[dict(zip(names, s)) for s in scan(t or "")] for t in chunk.column("text").to_pylist()]
            columns = [chunk.column("key"), chunk.column("hash"), pa.array(found, struct)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "hash", "found"])

    scanned = picked.mapInArrow(work, f"key {kind}, hash long, found {SPANS}")
    return reliable_copy(scanned.withColumn("row", F.monotonically_increasing_id()))


def _linked(scanned: DataFrame) -> DataFrame:
    """``row``, ``weak``: the weak candidates of each row that have their complements in their scope."""
    parts = scanned.where("size(found) > 1").select("row", F.explode("found").alias("part")).select(
        "row", "part.*"
    )
    roles = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = F.try_element_at(roles, F.col("kind"))
    present = [F.coalesce(F.bool_or(role == r), F.lit(False)).alias(f"has_{r}") for r in ("id", "secret")]
    scopes = parts.groupBy("row", "scope").agg(
        F.min("start").alias("scope_start"), F.max("end").alias("scope_end"), *present
    )
    complete = F.lit(False)
    for kind, needs in NEEDS.items():
        met = F.col("kind") == kind
        for r in needs:
            met = met & F.col(f"has_{r}")
        complete = complete | met
    within = (F.col("start") >= F.col("scope_start")) & (F.col("end") <= F.col("scope_end"))
    weak = parts.join(scopes, ["row", "scope"]).where(within & complete)
    spans = F.collect_list(F.struct("kind", "scope", "start", "end")).alias("weak")
    return weak.groupBy("row").agg(spans)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``hash`` (XXH64 of the text), ``base`` and ``spans``: strong spans, and all spans."""
    scanned = _scanned(df, key, text)
    joined = scanned.join(_linked(scanned), "row", "left")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    spans = F.concat(base, F.coalesce("weak", F.array().cast(SPANS)))
    return joined.select(F.col("key").alias(key), "hash", _ordered(base).alias("base"), _ordered(spans).alias("spans"))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    return F.transform(
        F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with its columns; each run of spans in the texts becomes ``MASK``."""
    found = find_secrets(df, key, text).where("size(spans) > 0")
    found = found.select(F.col(key).alias("span_key"), F.col("hash").alias("span_hash"), "spans")
    found = found.groupBy("span_key", "span_hash").agg(F.first("spans").alias("spans"))
    columns = df.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    docs = df.select(row, F.col(key).alias("key"), F.col(text).alias("text"))
    same = F.col("key").eqNullSafe(F.col("span_key")) & (F.xxhash64("text") == F.col("span_hash"))
    joined = docs.join(found, same, "left").select("row", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            texts = chunk.column("text").to_pylist()
            for i, spans in enumerate(chunk.column("spans").to_pylist()):
                if spans:
                    texts[i] = masked(texts[i], [(s["start"], s["end"]) for s in spans])
            names = ["row", "text"]
            yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(texts, pa.string())], names)

    schema = joined.drop("spans").schema
    done = joined.mapInArrow(work, schema)
    return done.select(*(F.col("text") if c == text else F.col(f"row.`{c}`") for c in columns)).toDF(*columns)


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """Spans that overlap or touch make one mask; they come by start."""
    out, at, until = [], 0, None
    for start, end in spans:
        if until is None or start > until:
            if until is not None:
                out.append(MASK)
                at = until
            out.append(text[at:start])
        until = end if until is None else max(until, end)
    if until is not None:
        out += [MASK, text[until:]]
        return "".join(out)
    return text
