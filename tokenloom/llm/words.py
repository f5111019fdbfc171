"""Words of whole texts as hashed numbers, for operators that count or compare words."""

from __future__ import annotations

import numpy as np
import xxhash

HELD = 300_000


class WordHashes:
    """Words (runs without ASCII white space) of UTF-8 text to 64-bit hashes; a bounded cache saves hashing them again."""

    def __init__(self, held: int = HELD):
        self._held, self._known = held, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        new = set(words).difference(known)
        if len(known) + len(new) > self._held:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every width words in a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)  # an odd constant: multiplication is a bijection
            out ^= out >> np.uint64(29)
    return out
