"""N-gram Jaccard join by signature trees.

Two texts link if their sets of word shingles have a Jaccard similarity of at least ``percent`` / 100;
a component is what links reach. Words are what lies between ASCII white space, A-Z lower-cased; a text
with fewer words than a shingle has is one shingle.

1. Every set has a bitmap in which each shingle sets one bit (four to eight bits a shingle), its size,
   and how many shingles fell on a bit that was set (``excess``).
2. Sets that are similar share one of the first n - ceil(percent * n / 100) + 1 shingles of each, in any
   fixed order of all shingles. So a block is made of every such shingle that two sets share; blocks of
   the same members are one. The order puts common shingles last: they are counted in a sixteenth of
   the different texts (at most ``COMMON`` of them reach the driver and the tasks). The order decides how
   large the blocks are, never which links are found.
3. The members of a block are the leaves of a tree, in order of component, size and node. A node of the
   tree holds the OR of its members' bitmaps, their range of sizes, their largest excess and their range
   of components. Both trees of a pair are walked at once from the top; a pair of nodes is left if
   its maximum possible overlap (common bits and the lesser excess, or the size) is too small, if its
   sizes are too far apart, or if all its members are in one component already.
4. Of the pairs of leaves that remain, each set first gives those with the ``FIRST`` likeliest and the
   smallest partner; the pairs are verified on the sets, and components are made of the links. Blocks in
   which sets had more partners than they gave, and that hold several components still, are walked again
   with ``MORE`` times as many, until every pair that is left has been given. So groups of near copies take
   about as many comparisons as they have members, and no link between components is lost.
5. This is done first for the blocks that are the largest of one of their members, then for all others that
   hold several components and sets of several largest blocks; sets that have the same largest block need no
   comparison any more.
6. A caller may give another method's likely pairs, by SimHashes of the sets. They are verified first, and the
   trees are walked only for what their links leave in different components.

A block of more than ``LEAVES`` members is dealt out in parts; every two parts are a task's unit. Shingles are
64-bit hashes and nodes 64-bit hashes of sets: a false match has a chance of 2^-64 for each two.

Defined results: null and empty texts, and those without a word, have an empty set, which links with
nothing (with ``link_empty``: with each other); repeated rows stay, each with its component; a null
key stays null and never names a component that has another; ties do not occur, as a component's name
is its smallest key; an empty table gives an empty table. Only the key and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pac
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import text_chunks
from kpiloom.llm.components import components
from kpiloom.llm.contamination import shingle_hashes, word_hashes
from kpiloom.llm.simhash import majority
from kpiloom.sources.stage import discard, reliable_copy

#: One of so many texts is counted to find common shingles; fewer than ``SEEN`` of them are not common.
SAMPLE = 16
SEEN = 4
COMMON = 1 << 17
#: Children of a tree node, and members of a block's part.
CHILDREN = 8
LEAVES = 1024
#: Words of bitmaps that are compared at once.
TOGETHER = 1 << 18
#: Partners that a set gives at first, and how many times more each next time.
FIRST = 3
MORE = 8
#: Bits of the filters by which sets are made for candidates only, and shared shingles are found.
FILTER = 1 << 22
WIDE_FILTER = 1 << 25


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted different shingle hashes of each text."""
    words = [(t or "").encode().lower().split() for t in texts]
    sizes = [len(w) for w in words]
    hashes = word_hashes([x for w in words for x in w])
    for own in np.split(hashes, np.cumsum(sizes)[:-1]):
        yield np.unique(shingle_hashes(own, min(width, len(own)))) if len(own) else own


def node_of(shingles: np.ndarray) -> int:
    """Hash of a set, as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 1)).view(np.int64))


def bitmap(own: np.ndarray) -> np.ndarray:
    """Four to eight bits for each shingle, a power of two and 64 at least; each shingle sets one."""
    size = max(64, 1 << (4 * len(own) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def prefix(own: np.ndarray, percent: int, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: as many as similar sets must share one of."""
    need = len(own) + percent * len(own) // -100 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        often = np.where(common[at] == own, counts[at], 0)
        own = own[np.lexsort((own, often))]
    return own[:need]


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and how many of the sampled different texts hold each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            own = [np.empty(0, np.uint64), *shingle_sets(chunk.column("text").to_pylist(), width)]
            seen, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["h", "n"])

    some = docs.where(f"pmod(mark, {SAMPLE}) = 0").groupBy("mark").agg(F.min("text").alias("text"))
    counts = some.select("text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    shingles = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], top.column("n").to_numpy()[order]


def _rows(docs: DataFrame, width: int, percent: int, link_empty: bool, marked: bool) -> DataFrame:
    """``key``, ``mark``, ``node`` and ``n`` of every row; ``prefix`` and ``bits`` once a task for each set,
    and, if ``marked``, its SimHash ``fp``."""
    common, counts = _common(docs, width)
    kind = docs.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for chunk in text_chunks(batches, "text"):
            nodes, sizes, firsts, bits, fps = [], [], [], [], []
            for own in shingle_sets(chunk.column("text").to_pylist(), width):
                node = node_of(own) if len(own) or link_empty else None
                new = len(own) and node not in met
                met.add(node)
                nodes.append(node)
                sizes.append(len(own))
                firsts.append(prefix(own, percent, common, counts).view(np.int64) if new else None)
                bits.append(bitmap(own).tobytes() if new else None)
                fps.append(majority(own) if new and marked else None)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("key"),
                    chunk.column("mark"),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(firsts, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                    pa.array(fps, pa.uint64()).view(pa.int64()),
                ],
                ["key", "mark", "node", "n", "prefix", "bits", "fp"],
            )

    schema = f"key {kind}, mark long, node long, n long, prefix array<long>, bits binary, fp long"
    return reliable_copy(docs.mapInArrow(work, schema))


class Tree:
    """Members and, above them, nodes of ``CHILDREN`` each, up to a level of so many at most.

    Each level has the bitmaps, and the columns least size, largest size, largest excess, least and
    largest component, least and largest block in which the members have been compared.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tops: np.ndarray):
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, (sizes, sizes, excess, heads, heads, tops, tops))]
        while len(bits) > CHILDREN:
            starts = np.arange(0, len(bits), CHILDREN)
            bits = np.bitwise_or.reduceat(bits, starts, axis=0)
            ways = (np.minimum, np.maximum, np.maximum, *(np.minimum, np.maximum) * 2)
            self.levels.append(
                (bits, tuple(w.reduceat(c, starts) for w, c in zip(ways, self.levels[-1][1])))
            )


def walk(one: Tree, two: Tree, percent: int) -> tuple[np.ndarray, ...]:
    """Places of the members that can be similar and are of different components, and how similar at most.

    A tree against itself gives each pair once. The trees' bitmaps are of one width.
    """
    same = one is two
    depth = max(len(one.levels), len(two.levels))
    level = [t.levels + t.levels[-1:] * (depth - len(t.levels)) for t in (one, two)]
    p, q = np.meshgrid(*(np.arange(len(x[-1][0])) for x in level), indexing="ij")
    todo = [(depth - 1, p.ravel(), q.ravel())]
    found = [NONE]
    while todo:
        at, p, q = todo.pop()
        (pb, pc), (qb, qc) = level[0][at], level[1][at]
        most = max(1, TOGETHER // pb.shape[1])
        if len(p) > most:
            todo.append((at, p[most:], q[most:]))
            p, q = p[:most], q[:most]
        if same:
            p, q = (x[p <= q if at else p < q] for x in (p, q))
        (plo, phi, px, *ps), (qlo, qhi, qx, *qs) = ([c[i] for c in cols] for cols, i in ((pc, p), (qc, q)))
        fit = (100 * phi >= percent * qlo) & (100 * qhi >= percent * plo)
        for k in (0, 2):  # all of one component, or compared before
            fit &= (ps[k] != qs[k + 1]) | (ps[k + 1] != qs[k])
        p, q = p[fit], q[fit]
        shared = np.bitwise_count(pb[p] & qb[q]).sum(axis=1, dtype=np.int64) + np.minimum(px, qx)[fit]
        shared = np.minimum(shared, np.minimum(phi, qhi)[fit])
        least = (plo + qlo)[fit]
        fit = (100 + percent) * shared >= percent * least
        p, q = p[fit], q[fit]
        if not at:
            found.append((p, q, (shared / least)[fit]))
        elif len(p):
            p, q = (_children(i, level[k], at) for k, i in enumerate((p, q)))
            pick = (p[:, :, None] >= 0) & (q[:, None, :] >= 0)
            todo.append((at - 1, *(np.broadcast_to(x, pick.shape)[pick] for x in (p[:, :, None], q[:, None, :]))))
    return tuple(np.concatenate(x) for x in zip(*found))


def _children(nodes: np.ndarray, levels: list, at: int) -> np.ndarray:
    """The nodes below each one, -1 for none; a level that stands for itself has one."""
    if levels[at - 1] is levels[at]:
        return nodes[:, None]
    below = nodes[:, None] * CHILDREN + np.arange(CHILDREN)
    return np.where(below < len(levels[at - 1][0]), below, -1)


#: No pairs: two places or nodes, and the possible overlap as a share of both sizes.
NONE = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


class Members:
    """Members of a part of a block: a tree for each width of bitmaps."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tops: np.ndarray, bits: pa.Array):
        order = np.lexsort((nodes, sizes, np.where(nodes == heads, 0, heads), np.where(nodes == tops, 0, tops)))
        self.nodes, self.trees = nodes[order], {}
        for width, at, rows in _by_width(bits.take(pa.array(order))):
            columns = [c[order[at]] for c in (sizes, heads, tops)]
            self.trees[width] = (at, rows, columns, Tree(rows, *columns))

    def folded(self, width: int) -> Tree:
        """The tree of bitmaps of twice the width, folded to it."""
        _, rows, columns, _ = self.trees[2 * width]
        return Tree(_folded(rows), *columns)


def _by_width(bits: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each width of bitmaps: width in words, places, and a matrix of the bitmaps."""
    widths = pac.binary_length(bits).to_numpy(zero_copy_only=False) // 8
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        raw = b"".join(bits.take(pa.array(at)).to_pylist())
        yield width, at, np.frombuffer(raw, np.uint64).reshape(len(at), width)


def _folded(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] | rows[:, half:]


def candidates(one: Members, two: Members, percent: int) -> tuple[np.ndarray, ...]:
    """Nodes that can be similar, and how similar. Similar sets have bitmaps of one width or of the next."""
    found = [NONE]
    for x, y in ((one, two), (two, one)) if one is not two else ((one, one),):
        for width, (at, *_, tree) in x.trees.items():
            for other in (width, 2 * width):
                if other not in y.trees or other == width and x is not one:
                    continue
                against = y.trees[width][-1] if other == width else y.folded(width)
                i, j, alike = walk(tree, against, percent)
                found.append((x.nodes[at[i]], y.nodes[y.trees[other][0][j]], alike))
    return tuple(np.concatenate(x) for x in zip(*found))


def leaf_pairs(
    units: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tops: np.ndarray, bits: pa.Array, percent: int
) -> tuple[np.ndarray, ...]:
    """As ``candidates``, for many units of ``CHILDREN`` members at most, whose trees are their leaves.

    Gives places of the members; those of a unit come one after another.
    """
    p = np.concatenate([np.flatnonzero(units[:-d] == units[d:]) for d in range(1, CHILDREN)])
    q = p + np.repeat(np.arange(1, CHILDREN), [np.count_nonzero(units[:-d] == units[d:]) for d in range(1, CHILDREN)])
    fit = (heads[p] != heads[q]) & (tops[p] != tops[q])
    fit &= (100 * sizes[p] >= percent * sizes[q]) & (100 * sizes[q] >= percent * sizes[p])
    p, q = p[fit], q[fit]
    widths, place, rows = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), {}
    for width, at, some in _by_width(bits):
        widths[at], place[at], rows[width] = width, np.arange(len(at)), some
    p, q = np.where(widths[p] <= widths[q], p, q), np.where(widths[p] <= widths[q], q, p)
    shared = np.zeros(len(p), np.int64)
    for width in rows:
        for other, fold in ((width, lambda x: x), (2 * width, _folded)):
            for at in np.array_split(np.flatnonzero((widths[p] == width) & (widths[q] == other)), 1 + len(p) * width // TOGETHER):
                if not len(at):
                    continue
                x, y = rows[width][place[p[at]]], fold(rows[other][place[q[at]]])
                excess = [sizes[i] - np.bitwise_count(z).sum(axis=1, dtype=np.int64) for i, z in ((p[at], x), (q[at], y))]
                shared[at] = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + np.minimum(*excess)
    shared = np.minimum(shared, np.minimum(sizes[p], sizes[q]))
    both = sizes[p] + sizes[q]
    fit = (100 + percent) * shared >= percent * both
    return p[fit], q[fit], (shared / np.maximum(both, 1))[fit]


def given(units: np.ndarray, a: np.ndarray, b: np.ndarray, alike: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of the pairs of each unit, those of each node with its ``most`` likeliest and its smallest partner.

    Units, larger and smaller nodes, and whether the unit has pairs that are not given.
    """
    a, b = np.maximum(a, b), np.minimum(a, b)
    units2, x, y, alike2 = np.tile(units, 2), np.concatenate((a, b)), np.concatenate((b, a)), np.tile(alike, 2)
    keep = np.zeros(len(x), dtype=bool)
    for number, order in ((most, np.lexsort((y, -alike2, x, units2))), (1, np.lexsort((y, x, units2)))):
        new = np.ones(len(x), dtype=bool)
        new[1:] = np.diff(x[order]).astype(bool) | np.diff(units2[order]).astype(bool)
        first = np.flatnonzero(new)
        place = np.arange(len(x)) - np.repeat(first, np.diff(first, append=len(x)))
        keep[order] |= place < number
    keep = keep[: len(a)] | keep[len(a) :]
    return units[keep], a[keep], b[keep], np.isin(units, units[~keep])[keep]


UNIT = ["h", "i", "j"]


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units, whose rows come one after another."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([table.column(c).to_numpy() for c in UNIT])
        last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _pairs(members: DataFrame, percent: int, most: int) -> DataFrame:
    """``h``, ``a``, ``b`` and ``more``, whether the unit had other pairs than those it gave."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            keys = np.stack([table.column(c).to_numpy() for c in UNIT])
            nodes, sizes, heads, tops, side = (
                table.column(c).to_numpy() for c in ("node", "n", "head", "top", "side")
            )
            bits = table.column("bits").combine_chunks()
            new = np.ones(len(nodes), dtype=bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            starts, unit = np.flatnonzero(new), np.cumsum(new) - 1
            count = np.diff(starts, append=len(nodes))
            small = (count <= CHILDREN) & (keys[1, starts] == keys[2, starts])
            found = []
            if len(pool := np.flatnonzero(small[unit])) > 1:
                own = [c[pool] for c in (unit, sizes, heads, tops)]
                p, q, alike = leaf_pairs(*own, bits.take(pa.array(pool)), percent)
                found.append(given(unit[pool[p]], nodes[pool[p]], nodes[pool[q]], alike, most))
            for u in np.flatnonzero(~small):
                rows = slice(int(starts[u]), int(starts[u] + count[u]))
                parts = []
                for own in dict.fromkeys(keys[1:, starts[u]].tolist()):
                    at = starts[u] + np.flatnonzero(side[rows] == own)
                    parts.append(Members(nodes[at], sizes[at], heads[at], tops[at], bits.take(pa.array(at))))
                a, b, alike = candidates(parts[0], parts[-1], percent)
                found.append(given(np.full(len(a), u), a, b, alike, most))
            if found:
                u, a, b, more = (np.concatenate(x) for x in zip(*found))
                columns = [pa.array(keys[0, starts[u]]), pa.array(a), pa.array(b), pa.array(more)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "a", "b", "more"])

    return members.mapInArrow(work, "h long, a long, b long, more boolean")


def _in_filter(values: DataFrame, size: int) -> np.ndarray:
    """A bit for the lowest bits of each value. What reaches the driver has the size of the filter at most."""
    place = values.toDF("v").select(F.expr(f"v & {size - 1}").alias("p"))
    words = place.groupBy(F.expr("p div 32").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 32 AS int))")).alias("bits")
    )
    found = words.toArrow()
    bits = np.zeros(size // 32, dtype=np.uint32)
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bits


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & 32 * len(bits) - 1
    return (bits[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)


def _sets(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """``node`` and ``shingles`` of the texts whose ``mark`` is given, each node once."""
    bits = _in_filter(marks.select("mark"), FILTER)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            chunk = chunk.filter(pa.array(_passes(bits, chunk.column("mark").to_numpy())))
            if not chunk.num_rows:
                continue
            sets = list(shingle_sets(chunk.column("text").to_pylist(), width))
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([chunk.column("mark"), nodes, lists], ["mark", "node", "shingles"])

    made = docs.select("mark", "text").mapInArrow(work, "mark long, node long, shingles array<long>")
    return made.join(marks, ["mark", "node"], "left_semi").dropDuplicates(["node"]).drop("mark")


def _verified(docs: DataFrame, pairs: DataFrame, marks: DataFrame, width: int, percent: int) -> DataFrame:
    """``a``, ``b``: the similar pairs, by their sets. The texts of these nodes are read again."""
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().toDF("node")
    wanted = reliable_copy(marks.join(wanted, "node", "left_semi"))
    sets = reliable_copy(_sets(docs, wanted, width))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = (100 + percent) * F.size(F.array_intersect("x", "y"))
    links = reliable_copy(both.where(shared >= percent * (F.size("x") + F.size("y"))).select("a", "b"))
    discard(sets)
    discard(wanted)
    return links


def _members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``h``, ``node`` of the blocks, those of the same members once; and ``h``, ``members``, ``parts`` of each."""
    first = rows.where("prefix IS NOT NULL").select("node", "prefix")
    placed = first.select("node", F.explode("prefix").alias("h"))
    shared = placed.groupBy("h").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    shared = reliable_copy(shared.select("h"))
    bits = _in_filter(shared, WIDE_FILTER)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            h = lists.flatten().to_numpy()
            nodes = np.repeat(batch.column("node").to_numpy(), np.diff(lists.offsets.to_numpy()))
            fit = _passes(bits, h)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[fit]), pa.array(h[fit])], ["node", "h"])

    likely = first.mapInArrow(work, "node long, h long")
    members = reliable_copy(likely.join(shared, "h").distinct())
    blocks = members.groupBy("h").agg(
        F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    blocks = blocks.groupBy("members", "x", "y").agg(F.min("h").alias("h"))
    blocks = reliable_copy(blocks.select("h", "members", F.ceil(F.col("members") / LEAVES).alias("parts")))
    kept = reliable_copy(members.join(blocks.select("h"), "h"))
    discard(members)
    discard(shared)
    return kept, blocks


def _dealt(members: DataFrame, sketches: DataFrame, blocks: DataFrame) -> DataFrame:
    """The members of every unit, unit by unit: each two parts ``i`` and ``j`` of a block."""
    own = members.join(blocks, "h").join(sketches, "node")
    own = own.withColumn("side", F.expr("pmod(xxhash64(node, 2), parts)"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    i, j = F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")
    own = own.select("h", i, j, "side", "node", "n", "head", "top", "bits")
    return own.repartition(*UNIT).sortWithinPartitions(*UNIT)


def links_of(
    docs: DataFrame,
    rows: DataFrame,
    width: int,
    percent: int,
    likely: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``node``, ``head``: the component of every node that has a link, by the links that join components.

    ``rows``, a copy with all prefixes and bitmaps, is taken away as soon as the blocks are made.
    """
    marks = reliable_copy(rows.where("prefix IS NOT NULL").groupBy("node").agg(F.min("mark").alias("mark")))
    members, blocks = _members(rows)
    needed = members.select("node").distinct()
    sketches = rows.where("bits IS NOT NULL").join(needed, "node", "left_semi").select("node", "n", "bits")
    sketches = reliable_copy(sketches.dropDuplicates(["node"]))
    tops = members.join(blocks, "h").groupBy("node").agg(F.max(F.struct("members", "h")).alias("top"))
    tops = reliable_copy(tops.select("node", "top.h").withColumnRenamed("h", "top"))
    largest = tops.select(F.col("top").alias("h")).distinct()
    head, top = F.coalesce("head", "node").alias("head"), F.coalesce("top", "node").alias("top")
    empty = members.selectExpr("node", "node AS head").limit(0)
    links = heads = done = None
    if likely is not None:
        fps = rows.where("fp IS NOT NULL").select("node", "fp").dropDuplicates(["node"])
        done = reliable_copy(likely(fps))
    discard(rows)
    if done is not None:
        links = _verified(docs, done, marks, width, percent)
        heads = components(links)
    for own, compared in (
        (members.join(largest, "h"), members.selectExpr("node", "node AS top").limit(0)),
        (members.join(largest, "h", "left_anti"), tops),
    ):
        most, cut = FIRST, None
        while True:
            left = own if cut is None else own.join(cut, "h")
            if heads is not None:
                left = left.join(heads, "node", "left").join(compared, "node", "left")
                every = reliable_copy(left.select("h", "node", head, top))
                ends = [f(c).alias(f.__name__ + c) for c in ("head", "top") for f in (F.min, F.max)]
                mixed = every.groupBy("h").agg(*ends).where("minhead < maxhead AND mintop < maxtop")
                left = reliable_copy(every.join(mixed.select("h"), "h"))
                discard(every)
                if left.isEmpty():
                    break
            else:
                left = left.join(compared, "node", "left").select("h", "node", F.col("node").alias("head"), top)
            pairs = reliable_copy(_pairs(_dealt(left, sketches, blocks), percent, most))
            if heads is not None:
                discard(left)
            cut = pairs.where("more").select("h").distinct()
            pairs = pairs.select("a", "b").distinct()
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = reliable_copy(pairs)
            done = pairs if done is None else done.unionByName(pairs)
            if not pairs.isEmpty():
                new = _verified(docs, pairs, marks, width, percent)
                links = new if links is None else links.unionByName(new)
                heads = components(links)
            if cut.isEmpty():
                break
            most *= MORE
    return empty if heads is None else heads


def similar_groups(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 4,
    percent: int = 85,
    link_empty: bool = False,
    likely: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest key that links reach, of every row.

    ``likely`` makes likely pairs (``a``, ``b``) from ``node`` and ``fp``; it decides the work, never the links.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    rows = _rows(docs, width, percent, link_empty, likely is not None)
    own = reliable_copy(rows.select("key", "node", "n"))
    heads = links_of(docs, rows, width, percent, likely)
    named = own.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"))
    named = named.join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
    named = reliable_copy(named)
    lowest = named.groupBy("head").agg(F.min("least").alias("component_id"))
    named = reliable_copy(named.join(lowest, "head").select("node", "component_id"))
    return own.join(named, "node", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )
