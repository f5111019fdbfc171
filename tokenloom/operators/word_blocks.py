"""Many words in one flat array: merges and pair counts over whole blocks at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Ids up to which pairs are counted in a table of ids squared.
TABLE_IDS = 1024
BYTES = ["", *[f"{b:02X}" for b in range(256)]]  # names of ids; id 0 ends a word

Block = tuple[np.ndarray, np.ndarray]


def flat(words: list[str], counts: np.ndarray) -> Block:
    """Ids and weights: byte b of a word is id b + 1, each word ends with id 0, and every id has its word's count beside it."""
    coded = [w.encode() for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    ids = np.zeros(lengths.sum() + len(coded), np.uint32)
    ids[np.arange(lengths.sum()) + np.repeat(np.arange(len(coded)), lengths)] = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32) + 1
    return ids, np.repeat(np.asarray(counts, np.int64), lengths + 1)


def merged(block: Block, left: int, right: int, new: int) -> Block:
    """The block with (left, right) merged into new, from left to right without overlaps."""
    ids, weights = block
    hits = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
    if left == right and len(hits):  # of a run, every other
        runs = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
        hits = hits[(hits - np.repeat(hits[runs], np.diff(runs, append=len(hits)))) % 2 == 0]
    if not len(hits):
        return block
    keep = np.ones(len(ids), bool)
    keep[hits + 1] = False
    ids = ids.copy()
    ids[hits] = new
    return ids[keep], weights[keep]


def pairs(blocks: Iterable[Block], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right ids and weighted counts of neighbours in words, for ids under size; counts are exact below 2**53."""
    table, codes, counts = np.zeros(size * size if size <= TABLE_IDS else 0), [], []
    for ids, weights in blocks:
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code, n = ids[at].astype(np.int64) * size + ids[at + 1], weights[at]
        if size <= TABLE_IDS:
            table += np.bincount(code, n, len(table))
        else:
            codes, counts = _summed([*codes, code], [*counts, n])
    if size <= TABLE_IDS:
        codes = [np.flatnonzero(table)]
        counts = [table[codes[0]].astype(np.int64)]
    if not codes:
        return (np.zeros(0, np.int64),) * 3
    return codes[0] // size, codes[0] % size, counts[0]


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return [code], [np.bincount(where, np.concatenate(counts), len(code)).astype(np.int64)]


class Names:
    """Ids of tokens by their hexadecimal names; a token that comes about in two ways is one id."""

    def __init__(self) -> None:
        self.names = list(BYTES)
        self.ids = {n: i for i, n in enumerate(BYTES)}

    def step(self, left: str, right: str) -> tuple[int, int, int]:
        new = self.ids.setdefault(left + right, len(self.names))
        if new == len(self.names):
            self.names.append(left + right)
        return self.ids[left], self.ids[right], new


def most_frequent(blocks: Iterable[Block], names: list[str], most: int) -> list[tuple[str, str, int]]:
    """The most frequent pairs by falling (count, left, right)."""
    left, right, n = pairs(blocks, len(names))
    if len(n) > most:
        kept = n >= np.partition(n, len(n) - most)[len(n) - most]
        left, right, n = left[kept], right[kept], n[kept]
    return sorted(((names[a], names[b], int(c)) for a, b, c in zip(left, right, n)), key=lambda p: (p[2], p[0], p[1]), reverse=True)[:most]
