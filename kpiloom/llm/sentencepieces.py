"""SentencePiece encoding and decoding with vectorised merge rounds.

A BPE model with identity normalisation is applied to whole texts. The texts of a chunk are cut into
words that no piece can cross, every different word is encoded once, and all of them together: flat
symbol arrays, the lowest pair rank of each word by a segmented minimum, the leftmost merges of that
rank in all words at once, compaction, until no pair is left.

Defined results: null text counts as empty; an empty text has only the begin and end ids and decodes
to an empty text; texts of any length are encoded whole; repeated rows give repeated results; an
empty table gives an empty table. Only the key columns that are asked for are carried along, so
clashing names of other columns cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.llm.common import WordCache, binary_rows, ragged, text_chunks, unused_character

SPACE = "▁"
NO_RANK = np.iinfo(np.int32).max
#: Words whose ids a worker remembers; then it starts afresh.
CACHED_WORDS = 500_000
CODE_POINTS = 0x110000


class PieceCodec:
    """The model as lookup arrays, with a cache of encoded words."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        count = self.library.get_piece_size()
        ids = range(count)
        special = {
            i for i in ids if self.library.is_control(i) or self.library.is_unknown(i)
        }
        self.bytes = {
            int(self.library.id_to_piece(i)[1:-1], 16): i for i in ids if self.library.is_byte(i)
        }
        plain = {
            self.library.id_to_piece(i): i
            for i in ids
            if i not in special and not self.library.is_byte(i)
        }
        if len(self.bytes) != 256 or any(map(self.library.is_unused, ids)):
            raise ValueError("only models with byte fallback and without unused pieces are read")
        if any(SPACE in piece.lstrip(SPACE) for piece in plain):
            raise ValueError("the model has pieces that go across a space")
        self.count, self.newline = count, any("\n" in piece for piece in plain)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

        scores = np.array([self.library.get_score(i) for i in ids], dtype=np.float32)
        rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)
        pairs = {}
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                left, right = plain.get(piece[:cut]), plain.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (count + CODE_POINTS) + right] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_piece = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int32)
        self.pair_rank = rank[self.pair_piece]
        #: Symbols are piece ids, or ``count`` plus the code point where there is no piece.
        self.symbol = np.arange(count, count + CODE_POINTS, dtype=np.int32)
        for piece, i in plain.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

        surface = [b""] * count
        for piece, i in plain.items():
            surface[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            surface[i] = bytes([byte])
        surface[self.library.unk_id()] = self.library.decode([self.library.unk_id()]).encode()
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_size = np.array([len(s) for s in surface], dtype=np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.byte_id = np.array([self.bytes[b] for b in range(256)], dtype=np.int32)
        self.cache = WordCache(self.merge, CACHED_WORDS)
        probe = ["ab  c", " x\n\ty ", "é一\U0001f600"]
        if self.encode(pa.array(probe))[0].tolist() != sum(self.library.encode(probe), []):
            raise ValueError("only BPE models with identity normalisation are read")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of neighbouring symbols."""
        key = left.astype(np.int64) * (self.count + CODE_POINTS) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_rank[at], NO_RANK), self.pair_piece[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each word has."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym, word = self.symbol[points], np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        rank, piece = self._pairs(sym[:-1], sym[1:])
        rank, piece = np.append(rank, NO_RANK).astype(np.int32), np.append(piece, 0)
        if len(sym):
            rank[:-1][word[:-1] != word[1:]] = NO_RANK
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            ended = lowest == NO_RANK
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                sym, word, rank, piece, lowest = (x[~ended] for x in (sym, word, rank, piece, lowest))
                if not len(sym):
                    break
            at = self._leftmost(sym, word, rank, piece, np.flatnonzero(rank == lowest))
            sym[at] = piece[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
            for spot in (place, place[place > 0] - 1):
                inner = spot[spot + 1 < len(sym)]
                inner = inner[word[inner] == word[inner + 1]]
                rank[spot] = NO_RANK
                rank[inner], piece[inner] = self._pairs(sym[inner], sym[inner + 1])
                outer = spot[spot + 1 < len(sym)]
                rank[outer[word[outer] != word[outer + 1]]] = NO_RANK
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._fall_back(sym[order], word[order], len(words))

    def _leftmost(self, sym, word, rank, piece, at: np.ndarray) -> np.ndarray:
        """The merges of this round: from the left, without overlap, as far as the order allows.

        A merge that makes a pair of the same or a lower rank is the last one of its word in this
        round, as the merge of that pair comes before the next one of this rank.
        """
        run = np.flatnonzero(np.append(True, np.diff(at) != 1))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        group = np.flatnonzero(np.append(True, np.diff(word[at]) != 0))
        members = np.diff(np.append(group, len(at)))
        if len(group) == len(at):
            return at
        several = np.repeat(members > 1, members)
        single, at, members = at[~several], at[several], members[members > 1]
        new, own = piece[at], rank[at]
        left = sym[at - 1].copy()
        touching = np.flatnonzero(np.append(False, np.diff(at) == 2))
        left[touching] = new[touching - 1]
        has_left = (at > 0) & (word[at - 1] == word[at])
        after = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (word[after] == word[at])
        better = has_left & (self._pairs(left, new)[0] <= own)
        better |= has_right & (self._pairs(new, sym[after])[0] <= own)
        before = np.cumsum(better) - better
        base = np.repeat(before[np.cumsum(members) - members], members)
        return np.concatenate((single, at[before == base]))

    def _fall_back(self, sym, word, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes for the symbols that have no piece."""
        strange = sym >= self.count
        if not strange.any():
            return sym, np.bincount(word, minlength=words)
        points = (sym[strange] - self.count).astype(np.uint32)
        width = np.ones(len(sym), dtype=np.int64)
        width[strange] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        raw = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        out = np.repeat(sym, width)
        out[np.repeat(strange, width)] = self.byte_id[np.frombuffer(raw, dtype=np.uint8)]
        return out, np.bincount(np.repeat(word, width), minlength=words)

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words that no piece crosses, and how many each text has. Some may be empty."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        cut = unused_character(texts)
        full = pc.greater(pc.binary_length(texts), 0)
        texts = pc.binary_join_element_wise(pc.if_else(full, SPACE, ""), texts, "")
        if not self.newline:
            texts = pc.replace_substring(texts, "\n", f"{cut}\n{cut}")
        texts = pc.replace_substring(texts, " ", cut + SPACE)
        while pc.any(pc.match_substring(texts, SPACE + cut + SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE + cut + SPACE, SPACE + SPACE)
        lists = pc.split_pattern(texts, cut)
        return lists.flatten(), np.diff(lists.offsets.to_numpy())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        words, counts = self.words(texts)
        return self.cache.texts(words, counts)

    def framed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with begin and end ids around each text."""
        ids, sizes = self.encode(texts)
        sizes = sizes + 2
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        ends = np.cumsum(sizes)
        inside = np.ones(len(out), dtype=bool)
        inside[ends - 1] = inside[ends - sizes] = False
        out[inside], out[ends - sizes], out[ends - 1] = ids, self.begin, self.end
        return out, sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of id sequences that lie one after another."""
        width = self.surface_size[ids]
        raw = self.surface[ragged(self.surface_start[ids], width)].tobytes()
        ends = np.concatenate(([0], np.cumsum(width)))[np.cumsum(sizes)].tolist()
        shown = np.flatnonzero(width)
        id_ends = np.cumsum(sizes)
        lead = np.searchsorted(shown, id_ends - sizes)
        texts, start = [], 0
        for i, end in enumerate(ends):
            first = ids[shown[lead[i]]] if start < end else 0
            part = raw[start:end]
            try:
                texts.append(part[1:].decode() if self._has_space(first) else part.decode())
            except UnicodeDecodeError:  # bytes that no text has: as the library shows them
                texts.append(self.library.decode(ids[id_ends[i] - sizes[i] : id_ends[i]].tolist()))
            start = end
        return texts

    def _has_space(self, piece: int) -> bool:
        return self.surface_size[piece] > 0 and self.surface[self.surface_start[piece]] == 32


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_decode(df: DataFrame, model_file: str, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit, with begin and end), ``decoded``.

    ``model_file`` is a path that every executor has.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    picked = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(text).alias("text"))
    schema = T.StructType(
        [
            *picked.schema.fields[:-1],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for chunk in text_chunks(batches, "text"):
            ids, sizes = own.framed(chunk.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    *(chunk.column(n) for n in names),
                    pa.array(sizes, pa.int64()),
                    binary_rows(ids.astype("<u4"), 4 * np.cumsum(sizes)),
                    pa.array(own.decode(ids, sizes), pa.string()),
                ],
                [*names, "n_tokens", "ids", "decoded"],
            )

    return picked.mapInArrow(work, schema).toDF(*keys, "n_tokens", "ids", "decoded")
