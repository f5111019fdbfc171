"""Quality rules by line sequence labelling (operator 3).

Base figures of a whole text (words are runs without ASCII white space) reject first: fewer than
20 words, or more than 30 in 100 words inside 8-word windows that the text holds twice or more. The
others are judged line by line: a linear-chain conditional random field over the lines that hold a
word labels each content or boilerplate (Viterbi), and the share of words in content lines must reach
``SHARE``.

The field's features of a line are shares of character classes and of words equal to the one before,
its length, whether an earlier line equals it, and whether it is one of the short lines that recurred between different neighbours in training
(license lines, navigation). Its weights are trained here by conditional likelihood (forward-backward, Adam) on the lines of a bounded
sample of labelled documents, about ``SAMPLE_DOCS`` of each quality and the first ``SAMPLE_LINES`` lines of each.

Labels are of documents, so those of their lines are learned in ``ROUNDS`` rounds of constrained training. At first the lines of a good
document are content, but for repeated and recurring ones, and those of a bad document boilerplate. Each later round takes the labels that
the field of the round before gives, as long as they keep most words of a good document content and most of a
bad one boilerplate; repeated and recurring lines stay boilerplate. So both labels occur in one document, and the field learns to switch.

Everything but the fit covers all rows: texts are read whole, a batch of bounded bytes at a time.

Edge cases: null text has no words and fails the base rules; empty lines are no part of the sequence;
without labels of both kinds every line is content. Repeated rows are judged one by one. A document
with two labels counts as the lower one. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, session, small_batches
from .words import WordHashes, windows

SAMPLE_DOCS, SAMPLE_LINES, SHARE = 1000, 1024, 0.3
ROUNDS, RECURS, SHORT = 3, 5, 30  # a line of up to SHORT words recurs if RECURS different lines stand before or behind it
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
BATCH_BYTES, SEGMENT = 2 << 20, 64


def _is(chars) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    t[list(chars)] = 1
    return t


_SPACE, _SYMBOL, _UPPER, _DIGIT = _is(SPACES), _is(SYMBOLS), _is(range(65, 91)), _is(range(48, 58))
_LETTER = _is([*range(65, 91), *range(97, 123), *range(192, 256)])  # a byte from 192 begins a letter beyond ASCII
_START = _is([i for i in range(256) if i < 128 or i >= 192]) & (1 - _SPACE)  # begins a code point of a word
_MARK = _is(b"!?")
FEATURES = 10
_AGAIN, _RECURS = 8, 9


def measure(texts: list[bytes], hashes: WordHashes, recurring: frozenset[int] = frozenset()) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base figures of each text; features, words, text number and hash of each line that holds a word."""
    blob = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(blob, dtype=np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 10)[:-1] + 1])
    lines_of = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), lines_of)
    per_line = lambda table: np.add.reduceat(table[raw], starts, dtype=np.int64)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)
    chars, symbols, upper, digit, letter, mark = (per_line(t) for t in (_START, _SYMBOL, _UPPER, _DIGIT, _LETTER, _MARK))
    space = _SPACE[raw].astype(bool)
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.add.reduceat(begins, starts, dtype=np.int64)
    h = hashes.of(blob.split())
    line_of = np.repeat(np.arange(len(starts)), words)
    same = np.bincount(line_of[1:][(h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])], minlength=len(starts)) if len(h) > 1 else np.zeros(len(starts), np.int64)
    doc_of = doc[line_of]
    covered = _repeated(h, doc_of, len(texts))
    again, number, earlier = np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=np.uint64), 0
    for t, n in zip(texts, lines_of.tolist()):
        seen: set[bytes] = set()
        for i, line in enumerate(t.split(b"\n"), earlier):
            again[i] = line in seen
            seen.add(line)
            number[i] = xxhash.xxh3_64_intdigest(line.strip())
        earlier += n
    has = words > 0
    again &= has
    figures = {"n_words": per_doc(words), "word_chars": per_doc(chars), "n_symbols": per_doc(symbols), "n_dup_lines": per_doc(again), "n_repeat_words": covered}
    c, w = np.maximum(chars, 1), np.maximum(words, 1)
    x = np.stack([np.ones(len(starts)), symbols / c, upper / c, digit / c, letter / c, 10 * mark / c, same / w, np.log1p(words) / 4], axis=1)
    known = np.array([h in recurring for h in number.tolist()], dtype=bool) & (words <= SHORT)
    x = np.concatenate([x, again[:, None], known[:, None]], axis=1)
    return figures, x[has], words[has], doc[has], number[has]


def _repeated(h: np.ndarray, doc_of: np.ndarray, docs: int) -> np.ndarray:
    """Words of each text inside windows of 8 words that the text holds twice or more."""
    win = windows(h, WINDOW)
    if not len(win):
        return np.zeros(docs, np.int64)
    with np.errstate(over="ignore"):
        win = win ^ ((doc_of[: len(win)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    inside = np.flatnonzero(doc_of[: len(win)] == doc_of[WINDOW - 1 :])
    key = win[inside]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(docs, np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    first = inside[twice[at] == key]
    edge = np.bincount(first, minlength=len(h) + WINDOW) - np.bincount(first + WINDOW, minlength=len(h) + WINDOW)
    return np.bincount(doc_of, weights=np.cumsum(edge)[: len(h)] > 0, minlength=docs).astype(np.int64)


class LineField:
    """Linear-chain conditional random field over two labels (1: content)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, recurring: frozenset[int] = frozenset()):
        self.weights, self.moves, self.recurring = weights, moves, recurring  # (features, 2), (2, 2)

    @classmethod
    def learn(cls, sequences: list[np.ndarray], words: list[np.ndarray], labels: list[int], recurring: frozenset[int] = frozenset()) -> LineField:
        """From labels of documents: the labels of their lines are part of what is learned."""
        fixed = [(s[:, _AGAIN] > 0) | (s[:, _RECURS] > 0) for s in sequences]
        lines = [np.where(f, 0, y) for f, y in zip(fixed, labels)]
        field = cls.fit(sequences, lines, chain=False)  # at first each line alone: labels of whole documents would teach it never to switch
        for _ in range(ROUNDS - 1):
            for i, (s, w, y) in enumerate(zip(sequences, words, labels)):
                new = np.where(fixed[i], 0, field.content(s))
                if 2 * w[new == y].sum() > w.sum():
                    lines[i] = new
            field = cls.fit(sequences, lines, steps=100, begin=field)
        field.recurring = recurring
        return field

    @classmethod
    def fit(cls, sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 200, rate: float = 0.1, decay: float = 1e-4, begin: LineField | None = None, chain: bool = True) -> LineField:
        """Conditional likelihood of the lines' labels by Adam; sequences are cut to SEGMENT lines for training."""
        parts = [(s[i : i + SEGMENT], y[i : i + SEGMENT]) for s, y in zip(sequences, labels) for i in range(0, len(s), SEGMENT)]
        width = sequences[0].shape[1]
        x = np.zeros((len(parts), SEGMENT, width))
        live = np.zeros((len(parts), SEGMENT), dtype=bool)
        y = np.zeros((len(parts), SEGMENT), dtype=np.int64)
        for i, (s, own) in enumerate(parts):
            x[i, : len(s)], live[i, : len(s)], y[i, : len(s)] = s, True, own
        spread = x[live].std(axis=0)
        scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 1.0)  # features on one scale while fitting
        x *= scale
        theta = np.zeros(width * 2 + 4)
        if begin is not None:
            theta = np.concatenate([(begin.weights / scale[:, None]).ravel(), begin.moves.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        weight = live / np.maximum(live.sum(), 1)
        line, at = np.arange(len(y))[:, None], np.arange(SEGMENT)[None, :]
        both = (live[:, 1:] * weight[:, 1:])[:, :, None, None]
        for step in range(1, steps + 1):
            w, t = theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
            node, pair = cls._marginals(x @ w, t, live)
            node[line, at, y] -= 1
            gw = np.einsum("stf,stk->fk", x, node * weight[:, :, None])
            pair[line, at[:, :-1], y[:, :-1], y[:, 1:]] -= 1
            gt = (pair * both).sum(axis=(0, 1)) * chain
            g = np.concatenate([gw.ravel(), gt.ravel()]) + decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[: 2 * width].reshape(width, 2) * scale[:, None], theta[2 * width :].reshape(2, 2))

    @staticmethod
    def _marginals(e: np.ndarray, t: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels and of neighbouring pairs, by forward and backward sums in log space."""
        n = e.shape[1]
        lse = lambda a, axis: np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))
        f, b = [e[:, 0]], [np.zeros_like(e[:, 0])]
        for i in range(1, n):
            nxt = lse(f[-1][:, :, None] + t[None], 1) + e[:, i]
            f.append(np.where(live[:, i, None], nxt, f[-1]))
        for i in range(n - 2, -1, -1):
            nxt = lse(t[None] + (e[:, i + 1] + b[0])[:, None, :], 2)
            b.insert(0, np.where(live[:, i + 1, None], nxt, b[0]))
        z = lse(f[-1], 1)[:, None, None]
        f, b = np.stack(f, 1), np.stack(b, 1)
        node = np.exp(f + b - z) * live[:, :, None]
        pair = np.exp(f[:, :-1, :, None] + t[None, None] + (e + b)[:, 1:, None, :] - z[..., None]) * live[:, 1:, None, None]
        return node, pair

    def content(self, x: np.ndarray) -> list[int]:
        """Viterbi: the most probable labels of a text's lines."""
        if not len(x):
            return []
        e = (x @ self.weights).tolist()
        (a, b), (c, d) = self.moves.tolist()
        s0, s1 = e[0]
        back = []
        for u, w in e[1:]:
            stay, come = s0 + a, s1 + c
            leave, keep = s0 + b, s1 + d
            back.append((stay < come, leave <= keep))
            s0, s1 = (come if stay < come else stay) + u, (keep if leave <= keep else leave) + w
        label = int(s1 >= s0)
        out = [label]
        for from_0, from_1 in reversed(back):
            label = int(from_1 if label else from_0)
            out.append(label)
        return out[::-1]


def _batched(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Start and UTF-8 texts of stretches of at most about BATCH_BYTES (null: empty)."""
    texts = column.cast(pa.binary()).to_pylist()
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or b"") > BATCH_BYTES:
            yield at, [x or b"" for x in texts[at:i]]
            at, size = i, 0
        size += len(t or b"")
    if at < len(texts):
        yield at, [x or b"" for x in texts[at:]]


def judge(texts: list[bytes], field: LineField | None, hashes: WordHashes, share: float) -> dict[str, np.ndarray]:
    figures, x, words, doc, _ = measure(texts, hashes, field.recurring if field else frozenset())
    n, rep = figures["n_words"], figures["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    content = np.ones(len(words), dtype=np.int64)
    if field is not None:
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d in range(len(texts)):
            content[ends[d] : ends[d + 1]] = field.content(x[ends[d] : ends[d + 1]])
    good = np.bincount(doc, weights=words * content, minlength=len(texts)) / np.maximum(n, 1)
    return {**figures, "base_failed": failed, "kept": ~failed & (good >= share), "content_share": good}


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineField | None:
    """sample_docs: about how many labelled documents of each quality the field is fitted on, SAMPLE_LINES lines of each at most."""
    small_batches(session(docs))
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, F.lit(min(1.0, sample_docs / sizes[1]))).otherwise(F.lit(min(1.0, sample_docs / sizes[0])))
    drawn = marked.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))  # about 2 * sample_docs rows
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ys = b.column("y").to_pylist()
            ids = b.column("doc_id").to_pylist()
            for at, some in _batched(b.column("text")):
                _, x, words, doc, number = measure(some, hashes)
                cut = np.searchsorted(doc, np.arange(len(some) + 1))
                cut = list(zip(cut.tolist(), np.minimum(cut[1:], cut[:-1] + SAMPLE_LINES).tolist()))
                rows = [pa.array([v[i:j].tobytes() for i, j in cut], pa.binary()) for v in (x, words, number)]
                yield pa.record_batch([pa.array(ids[at : at + len(some)], pa.int64()), pa.array(ys[at : at + len(some)], pa.int32()), *rows], names=["doc_id", "y", "x", "words", "number"])

    got = sorted(texts.select("doc_id", "y", "text").mapInArrow(lines, "doc_id bigint, y int, x binary, words binary, number binary").where("octet_length(x) > 0").collect())
    if len({r["y"] for r in got}) < 2:
        return None
    x = [np.frombuffer(r["x"]).reshape(-1, FEATURES).copy() for r in got]
    words, number = ([np.frombuffer(r[c], dtype=t) for r in got] for c, t in (("words", np.int64), ("number", np.uint64)))
    recurring = recurring_lines(number, words)
    for s, n, w in zip(x, number, words):
        s[:, _RECURS] = [h in recurring and k <= SHORT for h, k in zip(n.tolist(), w.tolist())]
    return LineField.learn(x, words, [r["y"] for r in got], recurring)


def recurring_lines(numbers: list[np.ndarray], words: list[np.ndarray]) -> frozenset[int]:
    """Hashes of short lines that stand between many different ones: copies of a whole text share their lines' neighbours, boilerplate does not."""
    before: dict[int, set[int]] = {}
    behind: dict[int, set[int]] = {}
    for n, w in zip(numbers, words):
        row = [0, *n.tolist(), 0]
        for i, k in enumerate(w.tolist(), 1):
            if k <= SHORT:
                before.setdefault(row[i], set()).add(row[i - 1])
                behind.setdefault(row[i], set()).add(row[i + 1])
    return frozenset(h for h in before if max(len(before[h]), len(behind[h])) >= RECURS)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and content_share of every row."""
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hashes = WordHashes()
        for b in batches:
            for at, some in _batched(b.column("text")):
                got = judge(some, field, hashes, share)
                yield pa.record_batch([b.column("doc_id").slice(at, len(some)), *(pa.array(v) for v in got.values())], names=["doc_id", *got])

    columns = ", ".join(f"{c} bigint" for c in FIGURES)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {columns}, base_failed boolean, kept boolean, content_share double")


def good(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the rows that judged() would not keep; their columns stay as they are."""
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hashes = WordHashes()
        for b in batches:
            for at, some in _batched(b.column("text")):
                kept = judge(some, field, hashes, share)["kept"]
                yield b.slice(at, len(some)).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
