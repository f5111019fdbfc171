"""Mixture-controlled packing (operator 8): deficit round-robin over source queues.

Each source is a queue of its documents' tokens, cut into stretches: a document of up to a stretch's tokens is one,
a longer one is cut after each so many. In a round every source gains a quantum, its target share of a ``ROUNDS``-th of a
window of 4096 tokens, and gives its next stretches as long as its deficit (what it gained and has not
given yet) covers them; what is left is carried to the next round. A source's stretch is its quantum, but at least ``LEAST_STRETCH`` and at
most ``STRETCH`` tokens, so that every window, wherever rounds end, holds a source's target but for a quantum and two stretches. A source whose quantum is less than its next stretch
waits until it has saved enough, so rare sources come in whole stretches; one that runs dry drops out and the others
go on. The rounds in a row, sources in order of name, are one stream that is cut into windows of 4096 tokens, so
all windows but the last are full, no source is ever further than one stretch from its target, and windows need
not end where rounds do.

Nothing of this runs step by step. What a source has gained by round r is r quanta, and it has given the longest run
of stretches inside that; so a stretch that ends e tokens into its queue is given in round ceil(e / quantum), whatever
the other sources do, and deficits cross windows and partitions by arithmetic alone. Quanta are whole multiples of
1 / ``UNIT`` token, at least one, and all arithmetic is exact up to 10**14 tokens a source.

Targets: weights by source; sources without one come after all others, at their own shares. Without targets a source
weighs its tokens to the power ``alpha``: 1 keeps the corpus's own shares to the end (in the pipeline, the mixture that
the stage before made), less than 1 raises small sources.

Plan: texts are encoded once, in the order they are read, into a scratch table with each row's position inside its
task's part of its queue; sums by (task, queue) give positions in the queue, and sums by queue the quanta. Bounds
cut the rounds into as many parts of about equal tokens as a shuffle has partitions, a narrow pass counts the tokens of each
part exactly, and one shuffle brings the ids of each part together in the order of the stream. A hot source is a long
queue that all parts share. Sources stay in tables at any count; the driver sees one bound and one count a part.

Edge cases: null text counts as empty (only the end id); null source is a source of its own; rows
of no table give no pieces; repeated rows are packed as often as they stand, each at its own place; null
doc_id is kept. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fan_out, lean, range_bounds, session, small_batches, written
from .encoding import HELD, binary, drop_encoders, encoder

LENGTH, END_ID, UNIT = 4096, 2, 1 << 16
ROUNDS, LEAST_STRETCH, STRETCH = 8, 64, 512
SAMPLES, BROADCAST_ROWS = 1000, 500_000


def _encode(tokenizer: str, end_id: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        enc, task, at = encoder(tokenizer, held), TaskContext.get().partitionId(), {}
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                ids, n = enc.encode(some.column("text").cast(pa.binary()).to_pylist(), end_id)
                starts = []
                for q, x in zip(some.column("queue").to_pylist(), n.tolist()):
                    starts.append(at.get(q, 0))
                    at[q] = starts[-1] + x
                rows = [some.column("doc_id"), some.column("queue"), pa.array([task] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n)]
                yield pa.record_batch([*rows, binary(ids, 2 * np.append(0, np.cumsum(n)))], names=["doc_id", "queue", "task", "at", "n", "ids"])

    return run


class Runs:
    """What each document of a batch gives in one round: row, start, length and round of each run of its stretches."""

    def __init__(self, b: pa.RecordBatch):
        begin, n, quantum, after, stretches = (b.column(c).to_numpy() for c in ("begin", "n", "quantum", "after", "stretch"))
        many = -(-n // stretches)
        row = np.repeat(np.arange(len(n)), many)
        stretch = stretches[row]
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        end = np.minimum((nth + 1) * stretch, n[row])
        rounds = after[row] - -((begin[row] + end) * UNIT) // quantum[row]
        first = np.ones(len(row), dtype=bool)
        first[1:] = (row[1:] != row[:-1]) | (rounds[1:] != rounds[:-1])
        self.row, self.start, self.round = row[first], (nth * stretch)[first], rounds[first]
        last = np.append(first[1:], True)[: len(first)]
        self.length = end[last] - self.start


def _sizes(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Runs(b)
            part, at = np.unique(np.searchsorted(bounds, r.round, side="right"), return_inverse=True)
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(np.bincount(at, weights=r.length, minlength=len(part)).astype(np.int64))], names=["part", "n"])

    return run


def _dealt(bounds: list[int]):
    names = ["part", "round", "queue", "pos", "doc_id", "start", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        lean()
        for b in batches:
            r = Runs(b)
            row = pa.array(r.row)
            ids = b.column("ids").cast(pa.binary())
            at = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            pos, begins = b.column("begin").to_numpy()[r.row] + r.start, at[r.row] + 2 * r.start
            cells = [pa.array(np.searchsorted(bounds, r.round, side="right").astype(np.int32)), pa.array(r.round), b.column("queue").take(row), pa.array(pos), b.column("doc_id").take(row), pa.array(r.start), b.column("n").take(row)]
            yield pa.record_batch([*cells, binary(ids.buffers()[2] or b"", np.append(begins, at[-1]))], names=names)

    return run


def _filled(bases: dict[int, int], length: int):
    """Windows of the stream; runs of one document that meet inside a window are one piece."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        part, at = -1, 0
        held: list = []  # the last piece: the columns out, and the queue and place that would go on with it
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("ids").cast(pa.binary())
            cut = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 2
            n, parts = np.diff(cut), b.column("part").to_numpy()
            new = np.flatnonzero(np.append(parts[0] != part, parts[1:] != parts[:-1]))
            before = np.cumsum(n) - n
            shift = np.full(len(n), at, dtype=np.int64)
            for i in new.tolist():
                shift[i:] = bases[int(parts[i])] - before[i]
            begin = before + shift
            part, at = int(parts[-1]), int(begin[-1] + n[-1])
            window = begin // length
            many = (begin + n - 1) // length - window + 1
            row = np.repeat(np.arange(len(n)), many)
            w = window[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lo, hi = np.maximum(begin[row], w * length), np.minimum(begin[row] + n[row], (w + 1) * length)
            skip = lo - begin[row]
            start, pos, off = b.column("start").to_numpy()[row] + skip, b.column("pos").to_numpy()[row] + skip, cut[row] - cut[0] + skip
            flat = np.frombuffer(ids.buffers()[2], dtype="<u2")[cut[0] : cut[-1]] if len(n) and cut[-1] > cut[0] else np.zeros(0, "<u2")
            wide = memoryview(flat.astype("<u4")).cast("B")
            docs, queues, tokens = (b.column(c).to_pylist() for c in ("doc_id", "queue", "doc_tokens"))
            out = []
            for r, s, p, o, k, x, z in zip(row.tolist(), start.tolist(), pos.tolist(), off.tolist(), (hi - lo).tolist(), w.tolist(), (lo - w * length).tolist()):
                data = wide[4 * o : 4 * (o + k)]
                if held and s and held[5] == x and held[8] == p and held[7] == queues[r] and held[1] + held[2] == s:
                    held[3], held[2], held[8] = zlib.crc32(data, held[3]), held[2] + k, p + k
                else:
                    if held:
                        out.append(held[:7])
                    held = [docs[r], s, k, zlib.crc32(data), tokens[r], x, z, queues[r], p + k]
            yield _table(out, names)
        if held:
            yield _table([held[:7]], names)

    return run


def _table(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)


def quanta(queues: DataFrame, targets: dict | None, alpha: float, length: int = LENGTH, stretch: int | None = None) -> DataFrame:
    """queue, tokens, quantum (in 1 / UNIT tokens a round), stretch and after (the round before its first) of each queue.

    stretch: one for all queues, whose rounds are then a whole window; None: by each queue's quantum.
    """
    spark = session(queues)
    if targets is None:
        weighed = queues.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(float(alpha))))
    else:
        named = spark.createDataFrame([("-" if k is None else f"={k}", float(w)) for k, w in targets.items()], "queue string, weight double")
        weighed = queues.join(named, "queue", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    late = F.col("weight") == 0
    weighed = weighed.withColumn("late", late).withColumn("weight", F.when(late, F.col("tokens").cast("double")).otherwise(F.col("weight")))
    whole = {r["late"]: r["w"] for r in weighed.groupBy("late").agg(F.sum("weight").alias("w")).collect()}
    of = F.when(F.col("late"), F.lit(whole.get(True) or 1.0)).otherwise(F.lit(whole.get(False) or 1.0))
    each = weighed.withColumn("quantum", F.greatest(F.lit(1), F.round(F.col("weight") / of * F.lit(float(length * UNIT) / (1 if stretch else ROUNDS)))).cast("bigint"))
    each = written(each.select("queue", "tokens", "late", "quantum"), "packing-quanta")
    ends = F.expr(f"(tokens * {UNIT} + quantum - 1) div quantum")
    last = each.where("NOT late").agg(F.max(ends).alias("r")).head()["r"] or 0
    own = F.lit(stretch) if stretch else F.least(F.lit(STRETCH), F.greatest(F.lit(LEAST_STRETCH), F.expr(f"quantum div {UNIT}")))
    return each.select("queue", "tokens", "quantum", own.cast("bigint").alias("stretch"), F.when(F.col("late"), F.lit(last)).otherwise(F.lit(0)).cast("bigint").alias("after"))


def round_bounds(each: DataFrame, parts: int) -> list[int]:
    """Rounds that cut the stream into parts of about equal tokens, from tokens at even distances of every queue."""
    total = each.agg(F.sum("tokens").alias("n")).head()["n"] or 0
    step = max(1, total // (SAMPLES * parts))
    first = F.pmod(F.xxhash64("queue"), F.lit(step))
    at = each.withColumn("first", first).where("first < tokens").withColumn("at", F.explode(F.sequence("first", F.col("tokens") - 1, F.lit(step).cast("bigint"))))
    return range_bounds(at.withColumn("round", F.expr(f"after + ((at + 1) * {UNIT} + quantum - 1) div quantum")), "round", parts)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, targets: dict | None = None, alpha: float = 1.0, stretch: int | None = None, held: int = HELD) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: source to weight (None key: rows without a source); None: tokens to the power alpha. stretch: see quanta.
    held: chunks that a worker's cache holds, which changes its memory and time only.
    """
    spark = session(docs)
    small_batches(spark)
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    rows = docs.select("doc_id", "text", queue.alias("queue"))
    ids = written(rows.mapInArrow(_encode(tokenizer, end_id, held), "doc_id bigint, queue string, task int, at bigint, n bigint, ids binary"), "packing-ids")
    sums = ids.groupBy("task", "queue").agg(F.max(F.col("at") + F.col("n")).alias("tokens"))
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    sums = written(sums.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))), "packing-sums")
    each = quanta(sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")), targets, alpha, length, stretch)
    bases = written(sums.drop("tokens").join(each.drop("tokens"), "queue"), "packing-bases")
    parts = fan_out(spark)
    bounds = round_bounds(each, parts)
    placed = ids.join(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases, ["task", "queue"]).withColumn("begin", F.col("base") + F.col("at"))
    sizes = placed.select("begin", "n", "quantum", "after", "stretch").mapInArrow(_sizes(bounds), "part int, n bigint").groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row a part
    ahead, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        ahead[r["part"]], total = total, total + r["n"]
    runs = placed.select("doc_id", "queue", "begin", "n", "quantum", "after", "stretch", "ids").mapInArrow(_dealt(bounds), "part int, round bigint, queue string, pos bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary")
    stream = runs.repartitionById(parts, "part").sortWithinPartitions("part", "round", "queue", "pos")
    return stream.mapInArrow(_filled(ahead, length), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
