"""Hashes of any span of an array, from running sums."""

from __future__ import annotations

import numpy as np


class SpanHashes:
    """64-bit hashes of spans of an array of small integers: a polynomial over a random table of 64-bit values.

    Equal spans have equal hashes, but some differing ones do too (modulo a power of two any base has such pairs), so a
    hash may only propose what is then compared.
    """

    def __init__(self, symbols: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.table = random.integers(1, 2**64, symbols, np.uint64)
        base = int(random.integers(1, 2**63)) * 2 + 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            grown = np.full(n, self.base, np.uint64)
            back = np.full(n, self.inverse, np.uint64)
            grown[0] = back[0] = 1
            self.up, self.down = np.cumprod(grown), np.cumprod(back)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Running sums, from which spans() takes the hash of any span."""
        self.powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.table[codes] * self.up[: len(codes)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
