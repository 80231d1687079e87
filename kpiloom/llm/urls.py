"""URL filters by a bit-parallel automaton over glob rules.

All rules are simulated at once. Each has a bit for every place between its literals, packed one rule
after another into 64-bit words (the multiword Shift-And method). One step reads a byte of every URL
of a batch: the bits shift by one into the places whose literal is that byte, and stay where a
wildcard allows it. A rule matches where its last bit is set at the end.

In a glob, ``*`` stands for any run without a slash, ``**`` for any run, ``?`` for one byte; the glob
must fit the whole canonical URL: a dot, the host in lower case (A-Z), then the path. Of the rules
that match, the one with the highest tier counts, then the longest name; then the first.

Defined results: null URLs and those without ``://`` have an empty host and path, and are judged like
any other; repeated rows are judged each; URLs of any length are read whole; an empty table gives an
empty table. Only the key and URL columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.llm.common import text_chunks

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: URLs that are stepped through together.
TOGETHER = 4096


class Rule(NamedTuple):
    name: str
    glob: str
    verdict: str
    tier: int = 0


def host_rule(name: str, verdict: str, tier: int = 1) -> Rule:
    """A rule ``host/path``: the host with all its subdomains, and paths that start so."""
    host, _, path = name.partition("/")
    return Rule(name, f"*.{host}/{path}**", verdict, tier)


class Automaton:
    """Masks of all rules, by byte."""

    def __init__(self, globs: list[str]):
        takes: list[set[int] | None] = []  # the bytes that lead into each bit; None: any
        stays: list[str] = []
        starts, ends = [], []
        for glob in globs:
            starts.append(len(takes))
            takes.append(set())
            stays.append("")
            raw, at = glob.encode(), 0
            while at < len(raw):
                if raw[at] == ord("*"):
                    run = 2 if raw[at : at + 2] == b"**" else 1
                    stays[-1] = max(stays[-1], "*" * run)
                    at += run
                else:
                    takes.append(None if raw[at] == ord("?") else {raw[at]})
                    stays.append("")
                    at += 1
            ends.append(len(takes) - 1)
        self.words = max(1, -(-len(takes) // 64))
        self.ends = np.array(ends, dtype=np.int64)
        self.start = self._mask(starts)
        self.take = np.array([self._mask(i for i, t in enumerate(takes) if t is None or b in t) for b in range(256)])
        anywhere = self._mask(i for i, s in enumerate(stays) if s == "**")
        segment = self._mask(i for i, s in enumerate(stays) if s == "*")
        self.stay = np.array([anywhere | (0 if b == ord("/") else segment) for b in range(256)])

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for bit in bits:
            out[bit // 64] |= np.uint64(1 << bit % 64)
        return out

    def matches(self, strings: list[bytes]) -> np.ndarray:
        """A row for each string, a column for each rule."""
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        begins = (np.cumsum(sizes) - sizes)[order]
        lengths = sizes[order]
        state = np.repeat(self.start[None, :], len(strings), axis=0)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            alive = int(np.searchsorted(-lengths, -step, side="left"))  # longer than step
            byte = flat[begins[:alive] + step]
            own = state[:alive]
            moved = own << np.uint64(1)
            moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            state[:alive] = (moved & self.take[byte]) | (own & self.stay[byte])
        found = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((len(strings), len(self.ends)), dtype=bool)
        out[order] = found.astype(bool)
        return out


def judge(df: DataFrame, rules: list[Rule], default: str, key: str, url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (its name), ``tier`` and ``verdict`` of every URL.

    Where no rule matches, ``rule`` and ``tier`` are null and the verdict is ``default``.
    """
    ranked = sorted(rules, key=lambda r: (-r.tier, -len(r.name)))
    clean = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(clean, F.lit("://")), F.regexp_replace(clean, r"(?s)\A.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    picked = df.select(
        F.col(key).alias("key"), F.translate(host, UPPER, UPPER.lower()).alias("host"), path.alias("path")
    )
    picked = picked.withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    names = [r.name for r in ranked]
    verdicts, tiers = [r.verdict for r in ranked], [r.tier for r in ranked]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in ranked])
        for chunk in text_chunks(batches, "canonical"):
            for at in range(0, chunk.num_rows, TOGETHER):
                part = chunk.slice(at, TOGETHER)
                hits = automaton.matches([s.encode() for s in part.column("canonical").to_pylist()])
                best = np.where(hits.any(axis=1), hits.argmax(axis=1), -1).tolist() if names else [-1] * part.num_rows
                columns = [
                    part.column("key"),
                    part.column("host"),
                    part.column("path"),
                    pa.array([names[b] if b >= 0 else None for b in best], pa.string()),
                    pa.array([tiers[b] if b >= 0 else None for b in best], pa.int32()),
                    pa.array([verdicts[b] if b >= 0 else default for b in best], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "host", "path", "rule", "tier", "verdict"])

    text, number = T.StringType(), T.IntegerType()
    schema = T.StructType([picked.schema["key"]])
    for name, kind in (("host", text), ("path", text), ("rule", text), ("tier", number), ("verdict", text)):
        schema = schema.add(name, kind)
    return picked.mapInArrow(work, schema).withColumnRenamed("key", key)
