"""Token counts by a linear longest-match automaton (operator 7).

A word's word-piece length is the number of pieces that greedy longest-match from the left cuts it into.
A trie over the vocabulary gets failure links and, at each node, the number of pieces popped on
following the link (LinMaxMatch, Song et al. 2021), so one pass over the characters of a word counts its
pieces without building any and without stepping back. Pieces that begin a word carry a mark; the word is
read with that mark in front, so they can match nowhere else.

The automaton is built once on the driver; its size follows the vocabulary alone, which bounds the
broadcast. Workers keep counts of words they have met in a bounded cache.

Edge cases: a word with a place where no piece fits counts as one unknown token, as word-piece
models do; null or empty text has no words. Words are runs without ASCII white space, of any length.
Repeated rows are counted one by one. Further columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, session, small_batches

MARK = "▁"
_CHAR = 21  # bits of a code point
HELD = 400_000


class PieceCounter:
    """Counts pieces of words; 0 stands for a word that the vocabulary can't cut."""

    def __init__(self, pieces: Iterable[str], mark: str = MARK):
        self.mark = mark
        edges: dict[int, int] = {}
        ends, children = [False], [[]]
        for p in pieces:
            v = 0
            for c in p:
                key = v << _CHAR | ord(c)
                if key not in edges:
                    edges[key] = len(ends)
                    children[v].append((ord(c), len(ends)))
                    ends.append(False)
                    children.append([])
                v = edges[key]
            ends[v] = bool(p)
        fail, pops = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children[u]:
                queue.append(v)
                if ends[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, popped = fail[u], pops[u]
                while z >= 0 and z << _CHAR | c not in edges:
                    popped += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = edges[z << _CHAR | c], popped
        self.edges, self.fail, self.pops = edges, fail, pops

    def count(self, word: str) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        v = n = 0
        for c in map(ord, self.mark + word):
            while (nxt := edges.get(v << _CHAR | c)) is None:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 0
            v = nxt
        while v > 0:
            n += pops[v]
            v = fail[v]
        return n if v == 0 else 0


def vocabulary(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row."""
    small_batches(session(docs))
    shared = session(docs).sparkContext.broadcast(PieceCounter(vocabulary(model_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        counter, known = shared.value, {}
        for b in batches:
            out: list[list[int]] = [[], [], []]
            for t in b.column("text").cast(pa.binary()).to_pylist():
                words = t.split() if t else []
                tokens = unknown = 0
                for at in range(0, len(words), 1 << 16):
                    some = words[at : at + (1 << 16)]
                    new = set(some).difference(known)
                    if len(known) + len(new) > HELD:
                        known.clear()
                        new = set(some)
                    known.update((w, counter.count(w.decode())) for w in new)
                    counts = list(map(known.__getitem__, some))
                    none = counts.count(0)
                    tokens += sum(counts) + none
                    unknown += none
                for col, v in zip(out, (len(words), tokens, unknown)):
                    col.append(v)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
