"""The extended binary Golay code as a fuzzy hash of 24-bit segments."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the [23, 12, 7] code.
GENERATOR = 0b110001110101


def _remainder(vector: int) -> int:
    for bit in range(22, 10, -1):
        if vector >> bit & 1:
            vector ^= GENERATOR << (bit - 11)
    return vector


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of bytes at three places; the nearest errors of each syndrome, and where they start."""
    unit = [_remainder(1 << bit - 1) | 1 << 11 if bit else 1 << 11 for bit in range(24)]
    syndromes = np.zeros((3, 256), dtype=np.int64)
    for place in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    syndromes[place, value] ^= unit[8 * place + bit]
    errors: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(24), weight):
            syndrome = 0
            for bit in bits:
                syndrome ^= unit[bit]
            errors.setdefault(syndrome, []).append(sum(1 << bit for bit in bits))
    leaders = [errors[s] for s in range(4096)]
    starts = np.cumsum([0, *(len(x) for x in leaders)])
    return syndromes, np.array([e for x in leaders for e in x], dtype=np.int64), starts


def codeword_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices (12 bits) of all codewords within distance 4.

    A segment has one such codeword (distance 3 or less) or six (distance 4). Two segments that
    differ in at most one bit have one in common.
    """
    syndromes, leaders, starts = _tables()
    segments = segments.astype(np.int64)
    s = syndromes[0, segments & 255] ^ syndromes[1, segments >> 8 & 255] ^ syndromes[2, segments >> 16]
    counts = starts[s + 1] - starts[s]
    row = np.repeat(np.arange(len(segments)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, (segments[row] ^ leaders[starts[s][row] + within]) >> 12
