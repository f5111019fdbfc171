"""Language ID by word-first backoff (operator 2).

A word that training has seen in some language scores each language by the logarithm of its smoothed
relative frequency there. An unseen word is scored by its character n-grams: of length 5 where one of
them was seen, else of length 4, and so on down to 1; its score is the mean over the seen n-grams of the
first length that has any. A text's score of a language is the sum over all its words; the largest
wins (ties: the language first by name), and ``score`` is the share of that language under a softmax
of the mean score per word, times ``SHARPNESS``.

Training takes labelled texts only: of each language about ``sample_docs`` documents chosen by a hash
of doc_id and of all languages about ``SAMPLE_ALL`` (documented bounds; all of them where there are fewer), counted in Spark. The model holds
every word and n-gram of these texts with the languages that have it, one entry each, so the sample bounds what is broadcast, whatever
the number of languages.
Prediction reads every whole text, a batch at a time; a worker keeps scores of words it has met
in a bounded cache, which never changes a result.

Edge cases: null text or text without a letter gives ``und`` with score 0; so does every text
where nothing is labelled. Null lang trains nothing. Repeated rows are predicted one by one. lang,
source and doc_id are no inputs of a prediction. Further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, session, small_batches, written

SAMPLE_DOCS, SAMPLE_ALL, ORDERS, SHARPNESS = 2000, 40_000, (5, 4, 3, 2, 1), 4.0
UNKNOWN = "und"
HELD = 1 << 21  # scores that a worker's cache holds
DENSE = 1 << 22  # scores of an order that a worker keeps as a whole table; more languages or n-grams stay sparse, with the same scores


def _ranges(kinds: str) -> str:
    """A character class of all code points whose Unicode category begins with one of kinds."""
    out, first = [], None
    for c in range(0x110000 + 1):
        if c < 0x110000 and unicodedata.category(chr(c))[0] in kinds:
            first = c if first is None else first
        elif first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


#: A word is a letter and all letters and combining marks that follow it; anything else parts words.
PLAIN = re.compile(r"[^\W\d_]+")
WORD = re.compile(f"[^\\W\\d_]+(?:[{_ranges('M')}]+[^\\W\\d_]*)*")


def words_of(text: str) -> list[str]:
    """Words of a text in lower case; without a character from U+0300, where marks begin, a plainer pattern finds the same."""
    text = text.lower()
    return (PLAIN if text.isascii() or max(text) < "\u0300" else WORD).findall(text)


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text has remainder 1 by 3 (null: none)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and of their n-grams, summed a batch at a time."""
    from collections import Counter

    for b in batches:
        for at in range(0, b.num_rows, 256):
            some = b.slice(at, 256)
            words: dict[str, Counter] = {}
            for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, count in words.items():
                out = Counter({(0, w): n for w, n in count.items()})
                for w, n in count.items():
                    p = f"^{w}$"
                    for k in ORDERS:
                        for i in range(len(p) - k + 1):
                            out[k, p[i : i + k]] += n
                keys = list(out)
                yield pa.record_batch([pa.array([lang] * len(keys)), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array(list(out.values()), pa.int64())], names=["lang", "ord", "gram", "n"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_all: int = SAMPLE_ALL) -> dict:
    """The model, from rows with text and lang. sample_docs: labelled documents a language; sample_all: of all languages."""
    small_batches(session(docs))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "orders": {}}
    most = min(float(sample_docs), sample_all / len(langs))
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, most / sizes[g])))])
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    counts = labelled.where(drawn).select("lang", "text").mapInArrow(_grams, "lang string, ord int, gram string, n bigint")
    counts = written(counts.groupBy("ord", "gram", "lang").agg(F.sum("n").alias("n")), "language-counts")
    place = {g: i for i, g in enumerate(langs)}
    orders = {}
    for k in (0, *ORDERS):
        got = counts.where(F.col("ord") == k).orderBy("gram", "lang").select("gram", "lang", "n").toArrow()  # bounded by the sample
        gram = got.column("gram").combine_chunks().dictionary_encode()
        row = gram.indices.to_numpy()
        lang = np.array([place[g] for g in got.column("lang").to_pylist()], dtype=np.int32)
        n = got.column("n").to_numpy().astype(np.float64)
        below = np.bincount(lang, weights=n, minlength=len(langs)) + 0.5 * max(1, len(gram.dictionary))
        orders[k] = ({g: i for i, g in enumerate(gram.dictionary.to_pylist())}, np.searchsorted(row, np.arange(len(gram.dictionary) + 1)), lang, np.log((n + 0.5) / below[lang]), np.log(0.5 / below))
    forget(session(docs), counts)
    return {"langs": langs, "orders": orders}


class Scorer:
    """Scores of words under a model; remembers those of the words it met last."""

    def __init__(self, model: dict, held: int | None = None):
        self.langs, self._orders = model["langs"], model["orders"]
        self._held = held or max(1024, min(200_000, HELD // max(1, len(self.langs))))
        self._at: dict[str, int] = {}
        self._table = np.zeros((self._held + 1, max(1, len(self.langs))))
        self._dense = {}
        for k, (known, cuts, lang, score, unseen) in self._orders.items():
            if len(known) * len(self.langs) <= DENSE:
                self._dense[k] = np.tile(unseen, (len(known), 1))
                self._dense[k][np.repeat(np.arange(len(known)), np.diff(cuts)), lang] = score

    def _of(self, k: int, grams: list[str]) -> np.ndarray | None:
        """Mean score of those grams of an order that training saw."""
        known, cuts, lang, score, unseen = self._orders[k]
        seen = [known[g] for g in grams if g in known]
        if not seen:
            return None
        if k in self._dense:
            return self._dense[k][seen[0]] if len(seen) == 1 else self._dense[k][seen].sum(axis=0) / len(seen)
        total = np.zeros(len(self.langs))
        for i in seen:
            at = slice(cuts[i], cuts[i + 1])
            total[lang[at]] += score[at] - unseen[lang[at]]
        return total / len(seen) + unseen

    def word(self, w: str) -> np.ndarray:
        if (found := self._of(0, [w])) is not None:
            return found
        p = f"^{w}$"
        for k in ORDERS:
            found = self._of(k, [p[i : i + k] for i in range(len(p) - k + 1)])
            if found is not None:
                return found
        return np.zeros(len(self.langs))

    def _rows(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self._at)
        if len(self._at) + len(new) > self._held:
            self._at.clear()
            new = set(words)
        if len(new) > self._held:  # one text with more different words than the cache holds
            return np.array([self.word(w) for w in words])
        for w in new:
            self._at[w] = i = len(self._at)
            self._table[i] = self.word(w)
        return self._table[np.fromiter(map(self._at.__getitem__, words), dtype=np.int64, count=len(words))]

    def text(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        words = words_of(text)
        total = np.zeros(len(self.langs))
        for at in range(0, len(words), 1 << 16):
            total += self._rows(words[at : at + (1 << 16)]).sum(axis=0)
        mean = SHARPNESS * total / len(words)
        share = np.exp(mean - mean.max())
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        scorer = Scorer(model.value)
        for b in batches:
            rest = [c for c in b.schema.names if c != "text"]
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                got = [scorer.text(t) for t in some.column("text").to_pylist()]
                yield pa.record_batch([*(some.column(c) for c in rest), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Trains on the rows that are not held out and predicts all."""
    return predicted(docs, train(docs.where(~held_out(F.col("doc_id"))), sample_docs))


def in_known_language(docs: DataFrame, least: float, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs without the rows whose language is und or scores below least; their columns stay as they are."""
    model = train(docs.where(~held_out(F.col("doc_id"))), sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        scorer = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                got = [scorer.text(t) for t in some.column("text").to_pylist()]
                yield some.filter(pa.array([g != UNKNOWN and s >= least for g, s in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
