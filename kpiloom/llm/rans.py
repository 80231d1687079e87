"""Static range asymmetric numeral system over token ids.

States are 64-bit numbers of at least 2^31 and below 2^63; words of 32 bits go in and out. Symbol i
of a block belongs to lane i modulo the number of lanes, so one step handles a symbol of every lane.
A block needs nothing but the shared frequency table. Within a block, checkpoints keep the states of
all lanes and the place in the words, so that decoding can begin there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LOWEST = 1 << 31
LANES = 4096
#: Steps of a lane at least; shorter blocks have fewer lanes.
STEPS = 64
#: Steps between checkpoints.
CHECKPOINT = 128


class Block(NamedTuple):
    lanes: int
    states: np.ndarray  # a row of lanes for each checkpoint; the first is for step 0
    places: np.ndarray  # words that come before each checkpoint
    words: np.ndarray


class Table:
    """Frequencies that add up to a power of two, and the symbol of every number below it."""

    def __init__(self, frequencies: np.ndarray):
        self.bits = int(frequencies.sum()).bit_length() - 1
        if frequencies.sum() != 1 << self.bits:
            raise ValueError("the frequencies don't add up to a power of two")
        self.frequency = frequencies.astype(np.uint64)
        self.before = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.int32), frequencies)

    def encode(self, ids: np.ndarray) -> Block:
        lanes = int(np.clip(len(ids) // STEPS, 1, LANES))
        state = np.full(lanes, LOWEST, dtype=np.uint64)
        steps, chunks, marks, sent = -(-len(ids) // lanes), [], [], 0
        bits, room, low = np.uint64(self.bits), np.uint64(63 - self.bits), np.uint64(0xFFFFFFFF)
        for step in reversed(range(steps)):
            symbols = ids[step * lanes : (step + 1) * lanes]
            own, count = state[: len(symbols)], self.frequency[symbols]
            full = own >= count << room
            chunks.append((own[full] & low).astype("<u4"))
            sent += len(chunks[-1])
            own = np.where(full, own >> np.uint64(32), own)
            whole = own // count
            state[: len(symbols)] = (whole << bits) + (own - whole * count) + self.before[symbols]
            if step % CHECKPOINT == 0:
                marks.append((state.copy(), sent))
        marks = marks[::-1] or [(state, 0)]
        return Block(
            lanes,
            np.array([s for s, _ in marks], dtype="<u8"),
            np.array([sent - n for _, n in marks], dtype="<u4"),
            np.concatenate(chunks[::-1]) if chunks else np.empty(0, "<u4"),
        )

    def decode(self, block: Block, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block, from the last checkpoint before them."""
        lanes = block.lanes
        mark = start // lanes // CHECKPOINT
        state, place = block.states[mark].astype(np.uint64), int(block.places[mark])
        first, out = mark * CHECKPOINT, []
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        for step in range(first, -(-stop // lanes)):
            own = state[: min(lanes, stop - step * lanes)]
            slot = own & mask
            symbols = self.symbol[slot]
            out.append(symbols)
            own = self.frequency[symbols] * (own >> bits) + slot - self.before[symbols]
            short = np.flatnonzero(own < LOWEST)
            words = block.words[place : place + len(short)].astype(np.uint64)
            own[short] = (own[short] << np.uint64(32)) | words
            place += len(short)
            state[: len(own)] = own
        found = np.concatenate(out) if out else np.empty(0, np.int32)
        return found[start - first * lanes : stop - first * lanes]


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Shares of 2^bits in proportion to the counts, at least one for each symbol that occurs."""
    seen = counts > 0
    if not seen.any():
        return np.append([1 << bits], np.zeros(max(0, len(counts) - 1), np.int64))
    share = np.where(seen, np.maximum(1, counts / counts.sum() * (1 << bits)), 0).astype(np.int64)
    order = np.argsort(-share, kind="stable")
    for symbol in order:
        change = (1 << bits) - int(share.sum())
        share[symbol] = max(1, share[symbol] + change)
        if share.sum() == 1 << bits:
            return share
    raise ValueError("more symbols than shares")
