"""Words of texts as arrays of 64-bit hashes, and hashes of their runs."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from factgraph.llm.common import mixed

#: An odd base, so that its powers have inverses modulo 2**64, and its inverse.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)


def word_list(text: str | None, fold: bool = False) -> list[bytes]:
    """Words between space and \\t to \\r, as UTF-8; fold: with A to Z in lower case."""
    raw = (text or "").encode()
    return (raw.lower() if fold else raw).split()  # bytes: both touch ASCII alone


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)])
                self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, INVERSE, np.uint64)])
        return self.up, self.down


def window_hashes(words: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `length` words, each from the one before it.

    The rolling hash is taken as a difference of prefix sums, so the whole array rolls
    at once; equal runs give equal values wherever they stand.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers.upto(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)], dtype=np.uint64)]
        return mixed((sums[length:] - sums[:-length]) * down[:n])
