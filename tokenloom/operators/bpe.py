"""Byte-level byte-pair encoding: counts, training, encoding, decoding."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flat_text import Merger, text_bytes, word_starts
from ..functions.text import PRETOKEN, adjacent_pairs, byte_tokens, merge_pair, special_pattern, special_split
from ..sources.scratch import written
from . import word_blocks, word_phases
from .merging import merge_word, ranked

#: Distinct pre-tokens up to which one task trains with an index; beyond, the rounds are distributed.
ONE_TASK_WORDS = 2_000_000
#: Most frequent pairs that a distributed round looks at.
BATCH = 256


def pretoken_counts(docs: DataFrame, specials: list[str] | None = None) -> DataFrame:
    """word, cnt over all texts; specials are boundaries and are never counted. Workers count the words of a batch of texts, Spark sums up."""
    text = F.make_valid_utf8(F.coalesce("text", F.lit("")))
    texts = docs.select(text.alias("text"))
    if specials:
        pieces = docs.select(F.explode(special_split(text, specials)).alias("p")).where("NOT p.is_special")
        texts = pieces.select(F.col("p.piece").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column(0))
            cuts = [first + np.flatnonzero(word_starts(data[first:last], texts)) for first, last, texts in _portions(ends)]
            words = pa.LargeStringArray.from_buffers(sum(map(len, cuts)), pa.py_buffer(np.concatenate([*cuts, [len(data)]]).astype(np.int64)), pa.py_buffer(data))
            counts = words.value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("cnt"))


def _portions(ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last byte of a megabyte of texts (or one text) at a time, and where its texts begin that are not empty."""
    for first, after in _groups(ends):
        texts = ends[first:after]
        yield int(ends[first]), int(ends[after]), texts[np.diff(ends[first : after + 1]) > 0] - ends[first]


def _groups(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of a portion, from the first to the one after the last: a byte is one id at most."""
    first = 0
    while first < len(ends) - 1:
        after = max(first + 1, int(np.searchsorted(ends, ends[first] + HELD_BYTES // 4, "right")) - 1)
        yield first, after
        first = after


def word_tokens(counts: DataFrame) -> DataFrame:
    """word, cnt, tokens: one token a byte."""
    return counts.withColumn("tokens", byte_tokens(F.col("word")))


def pair_counts(words: DataFrame) -> DataFrame:
    """l, r, n: neighbouring tokens weighted by the counts of their words."""
    pairs = words.select("cnt", F.explode(adjacent_pairs(F.col("tokens"))).alias("p"))
    return pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("cnt").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The pair of highest count; ties go to the greatest (l, r) by bytes. No row if there is no pair."""
    return pairs.agg(F.max(F.struct("n", "l", "r")).alias("m")).where("m IS NOT NULL").select("m.l", "m.r", "m.n")


def merged(words: DataFrame, left: str | Column, right: str | Column) -> DataFrame:
    """Words after merging one pair everywhere."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return words.withColumn("tokens", merge_pair(F.col("tokens"), lit(left), lit(right)))


def independent(top: list[tuple[str, str, int]], known: set[str], whole: bool) -> list[tuple[str, str, int]]:
    """The first pairs of top (by falling rank) that are the next merges whatever the earlier of them change.

    Merging (a, b) lowers pairs that end in a or begin with b, and makes pairs no more frequent than those; so the batch
    ends where such a pair ranks as high by count, where a merge makes a token that others make too (known), and, unless top is
    whole, at the last count of top, whose ties may go on. A pair of one token twice makes pairs as frequent as half of itself
    (aa, a), which no other pair bounds: it ends the batch.
    """
    batch: list[tuple[str, str, int]] = []
    for left, right, n in top:
        touched = any(q not in batch and q[2] >= n and (q[1] == b[0] or q[0] == b[1]) for q in top for b in batch)
        if batch and (touched or batch[-1][0] == batch[-1][1] or batch[-1][0] + batch[-1][1] in known or not whole and n == top[-1][2]):
            break
        known.update(a + b for a, b, _ in batch)
        batch.append((left, right, n))
    return batch


#: Words of a block.
BLOCK_WORDS = 1 << 15
#: Merges that rounds act out on the blocks as written before the blocks are written anew.
KEPT_DELTAS = 12
BLOCK = "ids binary, counts binary, n bigint"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[word_blocks.Block]:
    """word, cnt as blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_WORDS):
            part = batch.slice(at, BLOCK_WORDS)
            yield word_blocks.flat(part.column("word").to_pylist(), part.column("cnt").to_numpy(zero_copy_only=False))


def _stored(blocks: Iterable[word_blocks.Block]) -> Iterator[pa.RecordBatch]:
    for ids, weights in blocks:
        ends = np.flatnonzero(ids == 0)
        yield pa.RecordBatch.from_pydict({"ids": [ids.astype("<u4").tobytes()], "counts": [weights[ends].astype("<i8").tobytes()], "n": pa.array([len(ends)], pa.int64())})


def stored_blocks(words: DataFrame) -> DataFrame:
    """ids, counts, n: blocks of word, cnt with their numbers of words, written by the job that makes the words."""
    return written(words.select("word", "cnt").mapInArrow(lambda b: _stored(_blocks(b)), BLOCK), "bpe-blocks")


def _loaded(batches: Iterable[pa.RecordBatch], steps: list[tuple[int, int, int]]) -> Iterator[word_blocks.Block]:
    """Stored blocks after steps, one at a time."""
    for batch in batches:
        for i, c in zip(batch.column("ids"), batch.column("counts")):
            ids, counts = np.frombuffer(i.as_py(), "<u4"), np.frombuffer(c.as_py(), "<i8")
            block = ids, np.repeat(counts, np.diff(np.flatnonzero(ids == 0), prepend=-1))
            for step in steps:
                block = word_blocks.merged(block, *step)
            yield block


def _rounds(ranked_pairs: Callable[[list[tuple[str, str, int]]], list[tuple[str, str, int]]], merges: int, most: int) -> list[tuple[str, str, int]]:
    """Merges from batches of independent pairs: ranked_pairs acts the last batch out and gives the most frequent pairs (most at most)."""
    out: list[tuple[str, str, int]] = []
    known: set[str] = set()
    batch: list[tuple[str, str, int]] = []
    while len(out) < merges:
        top = ranked_pairs(batch)
        batch = independent(top, known, len(top) < most)[: merges - len(out)]
        if not batch:
            break
        known.update(a + b for a, b, _ in batch)
        out += batch
    return out


def train_rounds(words: DataFrame, merges: int, most: int = BATCH) -> list[tuple[str, str, int]]:
    """Merges (l, r, n) in rank order from word, cnt, in distributed rounds of independent pairs."""
    return _block_rounds(stored_blocks(words), merges, most)


def _block_rounds(blocks: DataFrame, merges: int, most: int = BATCH) -> list[tuple[str, str, int]]:
    """The same from blocks (flat arrays of ids).

    A round reads them block by block, acts out the merges since the blocks were written, and counts pairs, which Spark sums up: one job a
    round, whose memory is that of a block and of a table of pairs. Blocks are written anew after KEPT_DELTAS.
    """
    state = {"blocks": blocks, "steps": []}
    names = word_blocks.Names()

    def ranked_pairs(batch: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
        steps = state["steps"] = state["steps"] + [names.step(a, b) for a, b, _ in batch]
        if len(steps) > KEPT_DELTAS:
            state["blocks"] = written(state["blocks"].mapInArrow(lambda b: _stored(_loaded(b, steps)), BLOCK), "bpe-blocks")
            steps = state["steps"] = []
        known = list(names.names)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left, right, n = word_blocks.pairs(_loaded(batches, steps), len(known))
            yield pa.RecordBatch.from_pydict({"l": pa.array([known[i] for i in left], pa.string()), "r": pa.array([known[i] for i in right], pa.string()), "n": pa.array(n, pa.int64())})

        counts = state["blocks"].mapInArrow(count, "l string, r string, n bigint").groupBy("l", "r").agg(F.sum("n").alias("n"))
        return [(r["l"], r["r"], r["n"]) for r in counts.orderBy(F.desc("n"), F.desc("l"), F.desc("r")).limit(most).collect()]

    return _rounds(ranked_pairs, merges, most)


def _incremental(words: list[list[str]], counts: list[int], merges: int) -> list[tuple[str, str, int]]:
    """The same merges with an index from pairs to words and a heap of counts."""
    total: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for w, (tokens, n) in enumerate(zip(words, counts)):
        for p in zip(tokens, tokens[1:]):
            total[p] += n
            where[p].add(w)
    flip = str.maketrans("0123456789ABCDEF", "FEDCBA9876543210")  # turns the order of hexadecimal digits around
    entry = lambda p: (-total[p], p[0].translate(flip) + "~", p[1].translate(flip) + "~", p)
    heap = [entry(p) for p in total]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < merges:
        top = heapq.heappop(heap)
        pair = top[3]
        if -top[0] != total.get(pair, 0) or not total[pair]:
            continue
        out.append((*pair, total[pair]))
        changed = set()
        for w in list(where[pair]):
            old, n, new, i = words[w], counts[w], [], 0
            for p in zip(old, old[1:]):
                total[p] -= n
                changed.add(p)
            while i < len(old):
                hit = i + 1 < len(old) and (old[i], old[i + 1]) == pair
                new.append(old[i] + old[i + 1] if hit else old[i])
                i += 2 if hit else 1
            words[w] = new
            for p in zip(new, new[1:]):
                total[p] += n
                where[p].add(w)
                changed.add(p)
        for p in changed:
            if total[p] > 0:
                heapq.heappush(heap, entry(p))
    return out


def train(docs: DataFrame, merges: int, specials: list[str] | None = None, one_task_words: int = ONE_TASK_WORDS) -> DataFrame:
    """rank, l, r, n. Counting is distributed; merging runs in one task up to one_task_words distinct words, in rounds beyond."""
    spark = docs.sparkSession
    stored = stored_blocks(pretoken_counts(docs, specials))
    if (stored.agg(F.sum("n").alias("n")).head()["n"] or 0) > one_task_words:
        rows = [(i, *m) for i, m in enumerate(_block_rounds(stored, merges))]
        return spark.createDataFrame(rows, "rank int, l string, r string, n bigint")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, names = list(_loaded(batches, [])), word_blocks.Names()

        def ranked_pairs(batch: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
            for a, b, _ in batch:
                step = names.step(a, b)
                blocks[:] = (word_blocks.merged(block, *step) for block in blocks)
            return word_blocks.most_frequent(blocks, names.names, BATCH)

        got = _rounds(ranked_pairs, merges, BATCH)
        columns = [pa.array([m[i] for m in got], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), *columns], names=["rank", "l", "r", "n"])

    return stored.coalesce(1).mapInArrow(fit, "rank int, l string, r string, n bigint")


#: Most frequent pairs that a phase looks at, ids of runs that its task takes, and places of pairs that the first phase begins with.
PHASE_PAIRS, PHASE_IDS, PHASE_PLACES = 1 << 18, 1 << 21, 1 << 22
#: A phase's bound is at least the highest count divided by so much: rarer pairs would fill its index and are seldom reached.
PHASE_FALL = 16


def train_phases(blocks: DataFrame, merges: int) -> list[tuple[str, str, int]]:
    """Merges (l, r, n) in rank order from stored blocks, for large vocabularies: the merges of train, many in a phase (word_phases).

    A phase counts pairs, cuts words into runs of the most frequent ones, and merges the distinct runs in one task, whose memory PHASE_IDS bounds; then the blocks
    are written anew with its merges. The driver holds the merges and PHASE_PAIRS pairs.
    """
    out: list[tuple[str, str, int]] = []
    names, places = word_blocks.Names(), PHASE_PLACES
    while len(out) < merges:
        current = blocks

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in word_phases.pair_counts(_loaded(batches, []))], names=["pair", "n", "places"])

        counts = current.mapInArrow(count, "pair bigint, n bigint, places bigint").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
        top = counts.orderBy(F.desc("n")).limit(PHASE_PAIRS).toArrow()
        if not top.num_rows:
            break
        pair, n, at = (np.array(top[c].to_pylist(), np.int64) for c in ("pair", "n", "places"))
        least = int(n.min()) + (len(n) == PHASE_PAIRS)  # further pairs may tie with the last one
        while True:
            bound = max(least, int(n[0]) // PHASE_FALL, int(n[min(int(np.searchsorted(np.cumsum(at), places, "right")), len(n) - 1)]))
            if bound > n[0]:  # more pairs tie for the first place than a phase looks at: the first one alone
                phase = [_first_of(counts, names.names, int(n[0]))]
                names.step(*phase[0][:2])
                break
            hot = np.sort(pair[n >= bound])

            def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for block in _loaded(batches, []):
                    yield from word_phases.runs(block, hot).combine_chunks().to_batches()

            runs = written(current.mapInArrow(cut, "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n")), "bpe-runs")
            ids = runs.agg(F.sum(F.octet_length("run")).alias("n")).head()["n"] // 4
            if ids > PHASE_IDS and bound < n[0]:
                places = min(places, int(at[n >= bound].sum())) // 2
                continue
            phase = _phase(runs, names, merges - len(out), bound)
            places *= 2 if ids < PHASE_IDS // 4 else 1
            break
        out += phase
        if len(out) < merges:
            steps = [names.step(a, b) for a, b, _ in phase]
            blocks = written(current.mapInArrow(lambda b: _stored(word_phases.acted(x, steps) for x in _loaded(b, [])), BLOCK), "bpe-blocks")
    return out


def _first_of(counts: DataFrame, names: list[str], n: int) -> tuple[str, str, int]:
    """The greatest (l, r) of the pairs counted n times."""
    table = counts.sparkSession.createDataFrame(list(enumerate(names)), "id bigint, name string")
    pairs = counts.where(F.col("n") == n).select(F.shiftright("pair", 32).alias("a"), (F.col("pair") % (1 << 32)).alias("b"))
    named = pairs.join(F.broadcast(table.toDF("a", "l")), "a").join(F.broadcast(table.toDF("b", "r")), "b")
    m = named.agg(F.max(F.struct("l", "r")).alias("m")).head()["m"]
    return m["l"], m["r"], n


def _phase(runs: DataFrame, names: word_blocks.Names, merges: int, bound: int) -> list[tuple[str, str, int]]:
    """The merges of a phase, found in one task from distinct runs; names gets their tokens."""
    known = list(names.names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_blocks.Names()
        own.names, own.ids = list(known), {n: i for i, n in enumerate(known)}
        got = word_phases.trained(word_phases.flat_runs(batches), own, merges, bound)
        columns = [pa.array([m[i] for m in got], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), *columns], names=["rank", "l", "r", "n"])

    rows = sorted(runs.coalesce(1).mapInArrow(fit, "rank int, l string, r string, n bigint").collect())
    for _, left, right, _ in rows:
        names.step(left, right)
    return [tuple(r)[1:] for r in rows]


def block_token_counts(blocks: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """token_id, n: how often each id comes about when all words of the blocks are encoded, by their counts; a word is encoded once."""
    names = word_blocks.Names()
    steps = [names.step(left, right) for left, right, _ in merges]
    ids = np.arange(-1, len(names.names) - 1)
    for rank, (_, _, new) in enumerate(steps):
        ids[new] = 256 + rank  # of equal tokens the last id counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for block in _loaded(batches, []):
            coded, weights = word_phases.encoded(block, steps)
            np.add.at(total, coded, weights)
        got = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[got], pa.int32()), pa.array(total[got])], names=["token_id", "n"])

    return blocks.mapInArrow(run, "token_id int, n bigint").groupBy("token_id").agg(F.sum("n").alias("n"))


def vocabulary(merges: DataFrame, specials: list[str] | None = None, vocab_size: int | None = None) -> DataFrame:
    """token_id, token (hex): specials, the 256 bytes, then merges in rank order."""
    spark, specials = merges.sparkSession, specials or []
    if vocab_size is not None and vocab_size < 256 + len(specials):
        raise ValueError("vocab_size has no room for specials and bytes")
    first = [(i, s.encode().hex().upper()) for i, s in enumerate(specials)] + [(len(specials) + b, f"{b:02X}") for b in range(256)]
    base = spark.createDataFrame(first, "token_id int, token string")
    out = base.unionByName(merges.select((F.col("rank") + 256 + len(specials)).cast("int").alias("token_id"), F.concat("l", "r").alias("token")))
    return out if vocab_size is None else out.where(F.col("token_id") < vocab_size)


class Tokenizer:
    """Encoding and decoding with a vocabulary and ranked merges, held as bounded driver-side maps."""

    def __init__(self, vocab: dict[int, str], merges: list[tuple[str, str]], specials: list[str] | None = None):
        self.vocab = vocab
        self.ids = {t: i for i, t in vocab.items()}  # of equal tokens the last id counts
        self.ranks = ranked(merges)
        self.specials = {s: self.ids[h] for s in specials or [] if (h := s.encode().hex().upper()) in self.ids}
        self.all_specials = list(specials or [])
        self.merger = None if specials else Merger.of(self.ids, merges)  # few merges: passes over all texts, without words

    @classmethod
    def of(cls, vocab: DataFrame, merges: DataFrame, specials: list[str] | None = None) -> Tokenizer:
        """From tables whose size is that of a vocabulary."""
        v = {r["token_id"]: r["token"] for r in vocab.orderBy("token_id").collect()}
        m = [(r["l"], r["r"]) for r in merges.orderBy("rank").collect()]
        return cls(v, m, specials)

    def word(self, word: str) -> list[int]:
        """The pair of lowest rank is merged everywhere, again and again, until none is known."""
        code = word.encode().hex().upper()
        return [self.ids[t] for t in merge_word([code[i : i + 2] for i in range(0, len(code), 2)], self.ranks)]

    def encode_text(self, text: str, known: dict[str, bytes]) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        import regex

        if not self.all_specials:
            return self._plain(regex.findall(PRETOKEN, text), known)
        pieces = regex.split(f"({special_pattern(self.all_specials)})", text)
        coded = (self.specials[p].to_bytes(4, "little") if i % 2 else self._plain(regex.findall(PRETOKEN, p), known) for i, p in enumerate(pieces))
        return b"".join(coded)

    def _plain(self, words: list[str], known: dict[str, bytes]) -> bytes:
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = np.array(self.word(w), "<i4").tobytes()
        return b"".join([known[w] for w in words])


#: Words that a worker remembers, and bytes of ids that it holds before it passes them on.
KNOWN_WORDS, HELD_BYTES = 300_000, 1 << 22


def coded(batches: Iterable[pa.RecordBatch], tok: Tokenizer) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with the ids of their texts, a few megabytes of ids at a time (or one text)."""
    known: dict[str, bytes] = {}
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        if tok.merger is not None:
            data, ends = text_bytes(texts)
            for first, after in _groups(ends):
                ids, at = tok.merger.encode(data[ends[first] : ends[after]], ends[first : after + 1] - ends[first])
                yield batch.slice(first, after - first), [ids[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]
            continue
        first, held, rows = 0, 0, []
        for text in texts:
            rows.append(np.frombuffer(tok.encode_text(text.as_py() or "", known), "<i4"))
            held += rows[-1].nbytes
            if held > HELD_BYTES:
                yield batch.slice(first, len(rows)), rows
                first, held, rows = first + len(rows), 0, []
        if rows:
            yield batch.slice(first, len(rows)), rows


def encode(docs: DataFrame, tok: Tokenizer, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """key, ids and the columns of keep: one pass over whole texts without a shuffle, by passes of few merges over many texts or word by word."""
    shared = docs.sparkSession.sparkContext.broadcast(tok)
    names = [key, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in coded(batches, shared.value):
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], names=[*names, "ids"])

    kinds = dict(docs.dtypes)
    shape = ", ".join(f"{n} {kinds[n]}" for n in names)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{shape}, ids array<int>")


def token_parts(docs: DataFrame, tok: Tokenizer) -> DataFrame:
    """token_id, n: counts of ids over parts of the texts, many rows of one id; their sum is the count."""
    shared = docs.sparkSession.sparkContext.broadcast(tok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sorted(set(shared.value.ids.values())), np.int64)
        total = np.zeros(len(names), np.int64)
        for _, rows in coded(batches, shared.value):
            total += np.bincount(np.searchsorted(names, np.concatenate(rows)), minlength=len(names))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[ids], pa.int32()), pa.array(total[ids])], names=["token_id", "n"])

    return docs.select("text").mapInArrow(run, "token_id int, n bigint")


#: Ids that are turned into bytes at once.
DECODED_IDS = 1 << 18


def decode(ids: Column, vocab: dict[int, str]) -> Column:
    """Text of an array of ids; broken UTF-8 becomes U+FFFD, an unknown id raises an error."""
    tokens = [bytes.fromhex(vocab.get(i) or "") for i in range(max(vocab, default=-1) + 1)]
    known = np.array([vocab.get(i) is not None for i in range(len(tokens))], bool)
    table, sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([*map(len, tokens)], np.int64)
    begins = np.cumsum(sizes) - sizes

    def portion(lists: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = lists.flatten()
        flat = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        strange = (flat < 0) | (flat >= len(known))
        strange[~strange] = ~known[flat[~strange]]
        if strange.any():
            raise ValueError(f"unknown token id {flat[strange][0]}")
        parts = []
        for at in range(0, len(flat), DECODED_IDS):
            some = flat[at : at + DECODED_IDS]
            n = sizes[some]
            parts.append(table[np.repeat(begins[some] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        size = np.concatenate([[0], np.cumsum(sizes[flat])])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(size[ends]), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *parts]))])
        texts = texts.cast(pa.binary())
        return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.binary())) if lists.null_count else texts

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, first = [pa.array([], pa.binary())], 0
        while first < len(lists):  # few rows at a time: working arrays are many times as large as ids
            after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + DECODED_IDS, "right")))
            parts.append(portion(lists.slice(first, after - first)))
            first = after
        return pa.concat_arrays(parts)

    return F.make_valid_utf8(joined(ids).cast("string"))
