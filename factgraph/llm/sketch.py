"""Fast similarity sketching of sets, and bands of sketches.

In round i every element is thrown, by a hash of that round, into one of t bins with the
value (i, hash); a bin keeps its smallest value. From round t on, round t + j throws all
elements into bin j, so each coordinate is filled after at most 2 t rounds; a set of
t ln t elements fills them in the first. Two sets agree in a coordinate with the
probability of their Jaccard similarity, with the concentration of independent trials.
"""

from __future__ import annotations

import math

import numpy as np

from factgraph.llm.common import mixed
from factgraph.llm.words import Powers, window_hashes, word_hashes, word_list

LOW = np.uint64((1 << 48) - 1)


def shingles(text: str | None, k: int, powers: Powers) -> np.ndarray:
    """Hashes of the distinct runs of k words, sorted; of the whole text if it has fewer words."""
    h = word_hashes(word_list(text, fold=True))
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(k, len(h)), powers))


def sketch(elements: np.ndarray, t: int = 128) -> np.ndarray:
    """t coordinates of a set that isn't empty."""
    out = np.full(t, np.uint64(0xFFFFFFFFFFFFFFFF))
    n, done = len(elements), 0
    together = max(1, min(t, math.ceil(1024 / n)))  # rounds at once, for small sets
    while done < t:
        rounds = np.arange(done, min(t, done + together))
        h = np.concatenate([mixed(elements, int(i) + 1) for i in rounds])
        value = (np.repeat(rounds, n).astype(np.uint64) << np.uint64(48)) | (h & LOW)
        np.minimum.at(out, ((h >> np.uint64(48)) % np.uint64(t)).astype(np.intp), value)
        done += len(rounds)
        if (out >> np.uint64(48) < t).all():
            return out
    for j in np.flatnonzero(out >> np.uint64(48) >= t):
        out[j] = (np.uint64(t + int(j)) << np.uint64(48)) | (mixed(elements, t + int(j) + 1) & LOW).min()
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each `rows` coordinates; keys of different bands differ."""
    grid = coordinates[: len(coordinates) // rows * rows].reshape(-1, rows)
    key = mixed(np.arange(len(grid), dtype=np.uint64), 99)
    for column in grid.T:
        key = mixed(key ^ column)
    return key


def similar_enough(t: int, similarity: float) -> int:
    """Coordinates that two sets of this similarity share, but for a chance of 1e-9 (six deviations)."""
    return math.floor(t * similarity - 6 * math.sqrt(t * similarity * (1 - similarity)))
