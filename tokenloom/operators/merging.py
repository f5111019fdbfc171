"""Ranked merges on the tokens of one word."""

from __future__ import annotations

import heapq
from bisect import bisect_left

Pair = tuple[str, str]


def ranked(merges: list[Pair]) -> dict[Pair, list[int]]:
    """Ranks of each pair, ascending; a pair may be learned again after its token came about in another way."""
    out: dict[Pair, list[int]] = {}
    for i, m in enumerate(merges):
        out.setdefault(m, []).append(i)
    return out


def merge_word(tokens: list[str], ranks: dict[Pair, list[int]], below: int | None = None, replay: bool = False) -> list[str]:
    """tokens after ranked merges: the pair of least rank is merged everywhere, from left to right, again and again.

    below: only ranks under it. replay: each merge acts once, in rank order, as training did; otherwise a pair that comes about
    later is merged by its least rank too. Tokens are a linked list and pairs stand in a heap by rank and place, so a
    word of n tokens takes n log n steps.
    """
    n = len(tokens)
    tokens, left, right = list(tokens), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, str, str]] = []

    def offer(at: int, least: int) -> None:
        after = right[at]
        if after < n:
            known = ranks.get((tokens[at], tokens[after]))
            if known:
                k = bisect_left(known, least) if replay else 0
                if k < len(known) and (below is None or known[k] < below):
                    heapq.heappush(heap, (known[k], at, tokens[at], tokens[after]))

    for at in range(n - 1):
        offer(at, 0)
    while heap:
        rank = heap[0][0]
        changed = []
        while heap and heap[0][0] == rank:
            _, at, a, b = heapq.heappop(heap)
            after = right[at]
            if tokens[at] != a or after >= n or tokens[after] != b:
                continue  # one of them has gone into another token
            tokens[at], tokens[after] = a + b, ""
            right[at] = right[after]
            if right[at] < n:
                left[right[at]] = at
            changed.append(at)
        for at in changed:
            if tokens[at]:
                if left[at] >= 0:
                    offer(left[at], rank + 1)
                offer(at, rank + 1)
    return [t for t in tokens if t]
