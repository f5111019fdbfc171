"""MinHash near-dedup by a multi-index Hamming join (operator 4).

A text's set is its distinct shingles of five words (ASCII letters in lower case); of a shorter text, the
whole word sequence; of one without words, empty. Two texts are linked when 100 times the intersection is
at least 75 times the union.

1. Equal sets become one class at once (grouped by a 128-bit hash of the set, partial minima
   before the shuffle), so copies are never compared, however many there are.
2. Each class has a signature of 128 MinHash symbols of 16 bits. The first 64 are cut into 16 chunks of 4.
   Two signatures that differ in at most ``RADIUS`` = 31 of them have, by pigeonhole, a chunk with at
   most one difference; dropping each symbol of each chunk in turn enumerates those, so the two share one of 64
   exact keys: no pair inside the threshold is missed. At a similarity of 0.75 the distance is 16 on
   average with a deviation of 3.5, so 31 loses about 1.5 links in 100,000 of those right at the threshold. The bound
   on all 128 symbols, ``RADIUS_ALL`` = 56, only saves exact checks and loses about 1.2 in 1,000,000.
3. First pass, linear: in each bucket of a key every class is paired with one pivot of its own, and
   each class keeps the ``PIVOTS`` nearest. These are confirmed on full sets, and their components found.
4. Second pass, complete: buckets that still span several components are compared in full by
   signature, between components only: the classes outside a bucket's largest component with those inside it and with
   each other, in blocks of about ``BLOCK`` classes. A large group that is one component already costs nothing, and
   one with up to ``BLOCK`` outliers a row for each class and one for each outlier and block. A pair within both thresholds is looked at under the first
   key it shares; rows with such a pair get their full sets, block by block, and only confirmed links leave
   the block, one for each row and other component. Components of all links are the result.

Nothing of document order reaches the driver, no bucket is held whole in a task, and all
intermediate tables are written to the shared folder.

Edge cases: null or empty text links with nothing and is kept; null doc_id takes part, but can't
name a component: of a group with a named document no row without doc_id is kept, of one without, one row; repeated rows of one doc_id with equal sets share a verdict (``deduplicated``
keeps one of a group, and each unlinked text of a repeated doc_id). Ties go to the smallest doc_id. Further columns are ignored or, in ``deduplicated``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import OWN, forget, lean, looked_up, release, session, small_batches, written
from .graph import components
from .words import WordHashes, windows

WIDTH, PERCENT = 5, 75
INDEXED, SYMBOLS, CHUNK = 64, 128, 4
RADIUS, RADIUS_ALL = 31, 56
PIVOTS, BLOCK = 2, 512

_rng = np.random.default_rng(20240607)  # a fixed seed: signatures of all runs and workers agree
_FACTORS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    return np.unique(windows(h, WIDTH)) if len(h) >= WIDTH else windows(h, len(h)) ^ np.uint64(len(h))


def signature(sets: np.ndarray) -> bytes:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(sets), 1024):
            x = sets[at : at + 1024, None] * _FACTORS[None, :]
            np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0), out=least)
        least = least * np.uint64(0xFF51AFD7ED558CCD)
    return (least >> np.uint64(48)).astype("<u2").tobytes()


def set_key(sets: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sets.tobytes())


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    hashes = WordHashes()
    for b in batches:
        out: list[list] = [[], [], [], []]
        for t in b.column("text").cast(pa.binary()).to_pylist():
            s = shingles(t, hashes)
            key = set_key(s) if len(s) else None
            for col, v in zip(out, (key, key and node_of(key), len(s), signature(s) if len(s) else None)):
                col.append(v)
        yield pa.record_batch([b.column("doc_id"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["doc_id", "set_key", "node", "n", "sig"])


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The 64 keys of each signature: chunk number, dropped place, the three symbols left."""
    chunks = sig[:, :INDEXED].reshape(len(sig), -1, CHUNK).astype(np.int64)
    number = np.arange(chunks.shape[1], dtype=np.int64)[None, :]
    out = np.empty((len(sig), chunks.shape[1], CHUNK), dtype=np.int64)
    for drop in range(CHUNK):
        key = number * CHUNK + drop
        for j in range(CHUNK):
            if j != drop:
                key = key << 16 | chunks[:, :, j]
        out[:, :, drop] = key
    return out.reshape(len(sig), -1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = chunk_keys(_symbols(b.column("sig")))
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), keys.shape[1]))], names=["key", "node"])


def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both signature-distance thresholds, row by row."""
    differs = x != y
    return (differs[..., :INDEXED].sum(-1) <= RADIUS) & (differs.sum(-1) <= RADIUS_ALL)


def _long_enough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A similarity of PERCENT is possible at these set sizes."""
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = _symbols(b.column("a_sig")), _symbols(b.column("b_sig"))
            ok = close(x, y) & _long_enough(b.column("a_n").to_numpy(), b.column("b_n").to_numpy())
            far = pa.array((x != y).sum(1)[ok].astype(np.int32))
            mask = pa.array(ok)
            yield pa.record_batch([b.column("a").filter(mask), b.column("b").filter(mask), far], names=["a", "b", "far"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each block; they come in order of block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = 0
        block = b.column("block").to_pylist()
        for i in range(1, len(block) + 1):
            if i == len(block) or block[i] != block[at]:
                if held and held[-1].column("block")[0].as_py() != block[at]:
                    yield held
                    held = []
                held.append(b.slice(at, i - at))
                at = i
    if held:
        yield held


class _Block:
    """Rows of one block and their near pairs between components, each at the first key that it shares."""

    def __init__(self, parts: list[pa.RecordBatch]):
        get = lambda c: np.concatenate([p.column(c).to_numpy() for p in parts])
        self.node, self.comp, self.n, self.side, self.key = (get(c) for c in ("node", "comp", "n", "side", "key"))
        self.sig = np.concatenate([_symbols(p.column("sig")) for p in parts])

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        row = np.arange(len(self.node))
        for i in row:
            if self.side[i] == 2:
                continue
            # one block against itself (side 0): each pair once; two blocks (1, 2): across only
            other = (self.side == 2) if self.side[i] == 1 else (self.side == 0) & (row > i)
            j = np.flatnonzero(other & (self.comp != self.comp[i]) & _long_enough(self.n, self.n[i]))
            j = j[close(self.sig[j], self.sig[i])]
            if not len(j):
                continue
            same = (self.sig[j, :INDEXED] == self.sig[i, :INDEXED]).reshape(len(j), -1, CHUNK)
            agree = same.sum(-1)[:, :, None]
            shared = agree - same == CHUNK - 1  # all places but the dropped one agree
            j = j[shared.reshape(len(j), -1).argmax(1) == self.key[i] >> 48]
            if len(j):
                yield i, j


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the rows that have a near pair."""
    for parts in _by_block(batches):
        block = _Block(parts)
        hit = np.zeros(len(block.node), dtype=bool)
        for i, j in block.pairs():
            hit[i] = hit[j] = True
        if hit.any():
            mask, table = pa.array(hit), pa.Table.from_batches(parts)
            yield from table.filter(mask).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, a confirmed link from each row to each other component that it links to, nearest first."""
    for parts in _by_block(batches):
        block = _Block(parts)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for p in parts for x in p.column("set")]
        a, b = [], []
        for i, j in block.pairs():
            j = j[np.argsort((block.sig[j] != block.sig[i]).sum(1), kind="stable")]
            done: set[int] = set()
            for some in (j[:8], j[8:]):
                some = np.array([x for x in some.tolist() if block.comp[x] not in done], dtype=np.int64)
                if not len(some):
                    continue
                every = np.concatenate([sets[x] for x in some])
                at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
                starts = np.concatenate([[0], np.cumsum([len(sets[x]) for x in some[:-1]])]).astype(np.int64)
                shared = np.add.reduceat((sets[i][at] == every).astype(np.int64), starts)
                for x in some[100 * shared >= PERCENT * (block.n[some] + block.n[i] - shared)].tolist():
                    if block.comp[x] not in done:
                        done.add(block.comp[x])
                        a.append(max(block.node[i], block.node[x]))
                        b.append(min(block.node[i], block.node[x]))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    hashes = WordHashes()
    for b in batches:
        node, sets = [], []
        for k, t in zip(b.column("node").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            s = shingles(t, hashes)
            own = node_of(set_key(s)) if len(s) else None
            if len(s) and k in (None, own):  # another row of this doc_id may hold another text
                node.append(own)
                sets.append(s.tobytes())
        yield pa.record_batch([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("a_set").to_pylist(), b.column("b_set").to_pylist())]
        mask = pa.array(ok, pa.bool_())
        yield pa.record_batch([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])


def sets_of(nodes: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, set of the given nodes, from the texts of their classes' first documents; without doc_id, from all such rows."""
    wanted, shape = nodes.join(reps.select("node", "doc_id"), "node"), "node bigint, set binary"
    sets = docs.join(wanted, "doc_id").select("node", "text").mapInArrow(_sets, shape)
    if reps.where("doc_id IS NULL").head(1):
        nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("bigint").alias("node"), "text").mapInArrow(_sets, shape)
        sets = sets.unionByName(nameless.join(wanted.where("doc_id IS NULL").select("node"), "node", "left_semi"))
    sets = written(sets.dropDuplicates(["node"]), "near-sets")
    release(session(docs))
    return sets


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), docs, reps)
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("b_set"))
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(_confirm, "a bigint, b bigint"), "near-links")
    forget(session(docs), sets)
    release(session(docs))
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _verdicts(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _verdicts(docs: DataFrame) -> DataFrame:
    """near_duplicates, with node and group (the root of its component) of every row."""
    spark = session(docs)
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    signed = written(docs.mapInArrow(_signed, "doc_id bigint, set_key binary, node bigint, n bigint, sig binary"), "near-signatures")
    some = signed.where("set_key IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node", "n", "sig")).alias("f")
    reps = written(some.groupBy("set_key").agg(first, F.count("*").alias("copies")).select("f.doc_id", "f.node", "f.n", "f.sig", "copies"), "near-classes")
    keys = reps.select("node", "sig").mapInArrow(_keys, "key bigint, node bigint")
    mix = F.xxhash64("key")
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.col("node").bitwiseXOR(mix)).alias("least")).where("size > 1")
    entries = written(keys.join(shared.select("key", F.col("least").bitwiseXOR(mix).alias("pivot")), "key"), "near-entries")
    release(spark)
    pairs = entries.where("node != pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    side = lambda s: reps.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("sig").alias(f"{s}_sig"))
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_sig", "b_sig").mapInArrow(_near, "a bigint, b bigint, far int"), "near-pivots")
    ends = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("far", F.xxhash64("a", "b")))
    best = ends.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    best = written(best, "near-best")
    links = confirmed(best, docs, reps)
    for done in (near, best):
        forget(spark, done)
    roots = written(components(links), "near-roots")
    more = _completed(entries, roots, reps, docs)
    forget(spark, entries)
    if more.head(1):
        roots = written(components(links.unionByName(more)), "near-roots")
    member = reps.select("node", "doc_id").join(roots, "node")
    names = member.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    of_node = looked_up(member.select("node", "root"), names, "root", "members", roots.count())
    alone = reps.select("node", F.col("doc_id").alias(f"{OWN}first"), "copies")
    known = written(alone.join(of_node, "node", "left"), "near-names")
    rows = signed.select("doc_id", "node", "n")
    out = looked_up(rows, known, "node", "copies", rows.count())
    out = out.unionByName(rows.where("node IS NULL"), allowMissingColumns=True)
    component = F.coalesce("component_id", f"{OWN}first", "doc_id")
    out = out.select("doc_id", "node", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("group"), component.alias("component_id"))
    plain = out.withColumn("kept", F.col("node").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    if not reps.where("doc_id IS NULL").head(1):
        return plain
    nameless = F.col("node").isNotNull() & F.col("component_id").isNull()
    one = F.row_number().over(Window.partitionBy("group").orderBy("node")) == 1
    return plain.where(~nameless).unionByName(out.where(nameless).withColumn("kept", one))


def _completed(entries: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between different components, of classes that share a key."""
    own = entries.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    own = written(own, "near-open")
    crossing = written(_crossing(own), "near-crossing")
    forget(session(docs), own)
    rows = crossing.join(reps.select("node", "n", "sig"), "node").select("block", "key", "node", "comp", "n", "sig", "side")
    shape = "block bigint, key bigint, node bigint, comp bigint, n bigint, sig binary, side int"
    needed = written(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_needed, shape), "near-needed")
    release(session(docs))
    sets = sets_of(needed.select("node").distinct(), docs, reps)
    full = needed.join(sets, "node").repartition("block").sortWithinPartitions("block").select("block", "key", "node", "comp", "n", "sig", "side", "set")
    links = written(full.mapInArrow(_linked, "a bigint, b bigint"), "near-links")
    for done in (sets, needed, crossing):
        forget(session(docs), done)
    release(session(docs))
    return links


def _crossing(own: DataFrame) -> DataFrame:
    """block, key, node, comp, side: the classes of own (key, node, comp) dealt to blocks where they meet those of other components of their bucket.

    The classes of a bucket's largest component (side 2) meet all others (side 1); these also meet each other, in blocks
    with themselves (side 0) and with every other block (sides 1 and 2).
    """
    mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    some = written(own.join(mixed, "key"), "near-mixed")
    sizes = some.groupBy("key", "comp").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).select("key", F.col("top.comp").alias("major"), F.col("top.n").alias("many"), (F.col("all") - F.col("top.n")).alias("few"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    rows = some.join(tops, "key").withColumn("inside", F.col("comp") == F.col("major"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), blocks("many")).otherwise(blocks("few"))).cast("int")
    rows = rows.withColumn("mine", mine)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    each = lambda c, f: F.transform(F.sequence(F.lit(0), blocks(c) - 1), f)
    own_block, side = F.col("mine"), lambda w: F.when(F.col("mine") == w, 0).when(F.col("mine") < w, 1).otherwise(2)
    inner = each("few", lambda w: place(0, own_block, w, F.lit(2)))
    outer = F.concat(each("many", lambda w: place(0, w, own_block, F.lit(1))), each("few", lambda w: place(1, F.least(own_block, w), F.greatest(own_block, w), side(w))))
    rows = rows.withColumn("x", F.explode(F.when(F.col("inside"), inner).otherwise(outer))).where("x.kind = 0 OR few > 1")
    return rows.select(F.xxhash64("key", "x.kind", "x.i", "x.j").alias("block"), "key", "node", "comp", F.col("x.side").alias("side"))


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the node of their text."""
    lean()
    hashes = WordHashes()
    for b in batches:
        nodes = []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            s = shingles(t, hashes)
            nodes.append(node_of(set_key(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], names=[*b.schema.names, f"{OWN}node"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: all its columns, of rows that near_duplicates keeps.

    Rows whose doc_id is unique go by it; those without one or with a repeated one by their text too, so of rows
    of one doc_id with different, unlinked texts each stays.
    """
    i, node, group, rank = (f"{OWN}{x}" for x in ("id", "node", "group", "rank"))
    kept = _verdicts(docs).where("kept").select(F.col("doc_id").alias(i), F.col("node").alias(node), F.col("group").alias(group)).distinct()
    kept = written(kept, "near-kept")
    often = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(i))
    single = docs.join(kept, docs["doc_id"] == kept[i], "left_semi")
    if not often.head(1) and not docs.where("doc_id IS NULL").head(1):
        return single
    often = written(often, "near-often")
    single = single.join(often, single["doc_id"] == often[i], "left_anti")
    odd = docs.join(often, docs["doc_id"] == often[i], "left_semi").unionByName(docs.where("doc_id IS NULL"))
    odd = odd.mapInArrow(_noded, StructType([*docs.schema.fields, StructField(node, LongType())]))
    verdict = kept.withColumnRenamed(node, f"{OWN}of")
    chosen = odd.join(verdict, odd["doc_id"].eqNullSafe(verdict[i]) & odd[node].eqNullSafe(verdict[f"{OWN}of"]))
    blank = F.col("doc_id").isNull() & F.col(node).isNull()  # link with nothing and have no id to repeat
    by = Window.partitionBy(group, F.when(F.col(node).isNull(), F.col("doc_id"))).orderBy(node)
    one = chosen.where(~blank).withColumn(rank, F.row_number().over(by)).where(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.unionByName(one.select(*columns)).unionByName(chosen.where(blank).select(*columns))
