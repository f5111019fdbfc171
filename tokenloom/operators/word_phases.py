"""Byte-pair training of large vocabularies in phases: many merges at a time, on the parts of words that they can reach.

A phase takes the pairs whose count is at least a bound. A merge joins two tokens at a place between two of today's tokens, and all
places of one later pair lie between the same two of today's tokens, as long as no token is made in two ways. So a pair's count is at most that of
today's pair there, and while merges count at least the bound, they lie inside runs of the phase's pairs. Equal runs of all words are
one row with their summed counts; one task merges them with an index of places until no count reaches the bound, or a token comes
about in a second way, which ends a phase.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from .word_blocks import Block, Names, merged

Step = tuple[int, int, int]
NONE = np.iinfo(np.int64).max
#: Codes that are held before they are summed.
HELD_CODES = 1 << 20


def codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | right.astype(np.int64)


def _inside(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))


def _summed(code: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    """Distinct codes and their sums."""
    if not len(code):
        return [code, *sums]
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return [code[first], *(np.add.reduceat(s[order], first) for s in sums)]


def pair_counts(blocks: Iterable[Block]) -> list[np.ndarray]:
    """Codes of pairs, their counts weighted by words, and their places in distinct words."""
    held, size = [], 0
    for ids, weights in blocks:
        at = _inside(ids)
        held.append(_summed(codes(ids[at], ids[at + 1]), weights[at], np.ones(len(at), np.int64)))
        size += len(held[-1][0])
        if size > HELD_CODES:
            held = [_summed(*map(np.concatenate, zip(*held)))]
            size = 0
    return _summed(*map(np.concatenate, zip(*held))) if held else [np.zeros(0, np.int64)] * 3


def _found(code: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where codes are among sorted ones, and whether."""
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return at, known[at] == code


def runs(block: Block, hot: np.ndarray) -> pa.Table:
    """run (ids as 32-bit integers), n: tokens joined by pairs of hot (sorted codes), equal ones summed."""
    ids, weights = block
    at = _inside(ids)
    linked = np.zeros(len(ids) + 1, bool)  # with the next token
    linked[at[_found(codes(ids[at], ids[at + 1]), hot)[1]]] = True
    kept = linked[:-1] | np.concatenate([[False], linked[:-2]])
    ends = np.flatnonzero((kept & ~linked[:-1])[kept]) + 1
    offsets = np.concatenate([[0], ends * 4]).astype(np.int64)
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids[kept].astype("<u4"))])
    summed = pa.table({"run": data, "n": weights[kept][ends - 1]}).group_by("run").aggregate([("n", "sum")])
    return pa.table({"run": summed["run"].cast(pa.binary()), "n": summed["n_sum"]})


def flat_runs(batches: Iterable[pa.RecordBatch]) -> Block:
    """All runs as one block that begins with id 0."""
    ids, weights = [np.zeros(1, np.uint32)], [np.zeros(1, np.int64)]
    for batch in batches:
        some = batch.column(0).cast(pa.large_binary())
        ends = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1] // 4
        if not len(some):
            continue
        lengths = np.diff(ends)
        data = np.frombuffer(some.buffers()[2], "<u4")[ends[0] : ends[-1]]
        out = np.zeros(len(data) + len(some), np.uint32)
        out[np.arange(len(data)) + np.repeat(np.arange(len(some)), lengths)] = data
        ids.append(out)
        weights.append(np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), lengths + 1))
    return np.concatenate(ids), np.concatenate(weights)


def trained(block: Block, names: Names, merges: int, least: int) -> list[tuple[str, str, int]]:
    """Merges (l, r, n) in rank order of runs that begin with id 0, while the best pair counts at least least; a token made a second time is the last."""
    ids, weights = block
    after, before = np.arange(1, len(ids) + 1, dtype=np.int32), np.arange(-1, len(ids) - 1, dtype=np.int32)
    at = _inside(ids).astype(np.int32)
    code = codes(ids[at], ids[at + 1])
    order = np.argsort(code, kind="stable")
    code, at = code[order], at[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weights[at], first).tolist() if len(code) else []
    total = dict(zip(code[first].tolist(), sums))
    where = {c: [p] for c, p in zip(total, np.split(at, first[1:]))}
    del code, first, sums
    flip = str.maketrans("0123456789ABCDEF", "FEDCBA9876543210")  # turns the order of hexadecimal digits around
    turned = [n.translate(flip) + "~" for n in names.names]
    low = (1 << 32) - 1
    entry = lambda c, n: (-n, turned[c >> 32], turned[c & low], c)
    heap = [entry(c, n) for c, n in total.items() if n >= least]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < merges:
        n, _, _, best = heapq.heappop(heap)
        if -n != total.get(best):
            continue
        left, right = best >> 32, best & low
        known = len(names.names)
        _, _, new = names.step(names.names[left], names.names[right])
        out.append((names.names[left], names.names[right], -n))
        if len(names.names) == known:
            break
        turned.append(names.names[new].translate(flip) + "~")
        i = np.sort(np.concatenate(where.pop(best)))
        i = i[(ids[i] == left) & (ids[after[i]] == right)]
        if left == right:  # of a run, every other
            start = np.flatnonzero(np.concatenate([[True], after[i[:-1]] != i[1:]]))
            i = i[(np.arange(len(i)) - np.repeat(start, np.diff(start, append=len(i)))) % 2 == 0]
        j = after[i]

        def neighbours(*ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            places = np.unique(np.concatenate(ends))
            places = places[(ids[places] > 0) & (ids[after[places]] > 0)]
            return codes(ids[places], ids[after[places]]), places

        old, places = neighbours(before[i], i, j)
        lost = _summed(old, weights[places])
        ids[i], ids[j] = new, 0
        after[i] = after[j]
        before[after[i]] = i
        made, places = neighbours(before[i], i)
        order = np.argsort(made, kind="stable")
        made, places = made[order], places[order]
        for c, k in zip(*(a.tolist() for a in lost)):
            total[c] -= k
            if total[c] >= least:
                heapq.heappush(heap, entry(c, total[c]))
        if len(made):
            first = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]]))
            gained = np.add.reduceat(weights[places], first)
            for c, k, p in zip(made[first].tolist(), gained.tolist(), np.split(places, first[1:])):
                total[c] = total.get(c, 0) + k
                where.setdefault(c, []).append(p)
                if total[c] >= least:
                    heapq.heappush(heap, entry(c, total[c]))
    return out


def encoded(block: Block, steps: list[Step]) -> Block:
    """The block after ranked steps: in each word the pair of least rank is merged everywhere, again and again. Words change their order."""
    if not steps or not len(block[0]):
        return block
    left, right, new = (np.array(x, np.int64) for x in zip(*steps))
    known, rank = np.unique(codes(left, right), return_index=True)  # of equal pairs the first
    done: list[Block] = []
    ids, weights = block
    while len(ids):
        ranks = np.full(len(ids), NONE)
        at = _inside(ids)
        place, found = _found(codes(ids[at], ids[at + 1]), known)
        ranks[at[found]] = rank[place[found]]
        ends = np.flatnonzero(ids == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        least = np.repeat(np.minimum.reduceat(ranks, starts), ends - starts + 1)
        rest = least == NONE
        done.append((ids[rest], weights[rest]))
        ids, weights, ranks, least = ids[~rest].copy(), weights[~rest], ranks[~rest], least[~rest]
        hits = np.flatnonzero(ranks == least)
        first = np.flatnonzero(np.diff(hits, prepend=-2) != 1)  # of a run of one token, every other
        hits = hits[(hits - np.repeat(hits[first], np.diff(first, append=len(hits)))) % 2 == 0]
        ids[hits] = new[ranks[hits]]
        keep = np.ones(len(ids), bool)
        keep[hits + 1] = False
        ids, weights = ids[keep], weights[keep]
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def acted(block: Block, phase: list[Step]) -> Block:
    """The block after the merges of a phase as training does them; the last one may make a token that others make, and acts once."""
    return merged(encoded(block, phase[:-1]), *phase[-1]) if phase else block
