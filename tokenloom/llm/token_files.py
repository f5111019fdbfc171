"""Token-id files (operator 6): frequency-ranked ids in byte-aligned variable-length code.

Format: a table of blocks, each of some documents that follow one another by doc_id: each id is replaced by its rank by falling frequency in the whole
corpus (ties by id) and stored in one to four bytes; two-bit lengths, four to a control byte, stand
apart from the data bytes (Stream VByte, Lemire, Kurz and Rupp 2018). A side table lists the ids by
rank. Blocks lie in one folder for each doc_id range, in ascending order of their names (part=000000 ...). Columns of a block: part and seq
(its place in the ascending order of doc_id), start (ids of all blocks before it), doc_ids, n_tokens (arrays), control, data (binary).
Decoding expands control bytes through a 256-row numpy table of lengths and gathers the data bytes;
there is no step per id.

Plan: one shuffle of the texts into doc_id ranges, as many as a shuffle has partitions and each a partition of its own; each is encoded once
and kept as 16-bit ids in a scratch table, where each task also leaves the counts of its ids, which are summed per id; the scratch
table is then coded in its own order. Every task holds one Arrow batch and one block. A task
that is run again writes the same rows, under Spark's commit protocol.

Edge cases: null text counts as the empty text, whose only id is the end id; rows of null doc_id
come first and rows of one doc_id are ordered by a hash of the text, inside each range if they are so many that they fill several; an empty table makes an empty
file table. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, fan_out, forget, lean, range_bounds, range_of, release, scratch_path, session, small_batches, written
from .encoding import binary, drop_encoders, encoder

END_ID = 0
BLOCK_IDS = 1 << 18

#: Row c: the byte lengths of the four values that control byte c describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Row c, for cells of 2 and of 4 bytes: which bytes of the four cells are stored.
USED = {cell: (np.arange(cell)[None, None, :] < LENGTHS[:, :, None]).reshape(256, 4 * cell) for cell in (2, 4)}


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    cell = 2 if int(values.max(initial=0)) < 1 << 16 else 4
    v = np.ascontiguousarray(values, dtype=f"<u{cell}")
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    raw = v.view(np.uint8)
    if cell == 2:
        used = raw != 0
        codes[: len(v)] = used[1::2]
        used[::2] = True
    else:
        for k in range(1, cell):
            codes[: len(v)] += v >= 1 << 8 * k
        used = (np.arange(cell, dtype=np.uint8) <= codes[: len(v), None]).reshape(-1)
    four = codes.view("<u4")
    return (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8).tobytes(), raw[used].tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The inverse of encode_values: tables give the places of the data bytes of four values at a time."""
    c = np.frombuffer(control, dtype=np.uint8)
    cell = 4 if (c & 0b10101010).any() else 2
    out = np.zeros(count * cell, dtype=np.uint8)
    out[np.take(USED[cell], c, axis=0).reshape(-1)[: count * cell]] = np.frombuffer(data, dtype=np.uint8)
    return out.view(f"<u{cell}")


def _ids(tokenizer: str, end_id: int):
    """Adds to each row its ids, its number in its part and the ids before it there; rows come in order of part.

    The last row of a task has no part but the counts of all its ids, as 64-bit numbers in id order.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        enc = encoder(tokenizer)
        part, seq, before = -1, 0, 0
        counts = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                ids, n = enc.encode(some.column("text").cast(pa.binary()).to_pylist(), end_id)
                counts += np.bincount(ids, minlength=1 << 16)
                parts = some.column("part").to_numpy()
                seqs, befores = seq + np.arange(len(n)), before + np.cumsum(n) - n
                for i in np.flatnonzero(np.append(parts[0] != part, parts[1:] != parts[:-1])).tolist():
                    seqs[i:] -= seqs[i]
                    befores[i:] -= befores[i]
                part, seq, before = int(parts[-1]), int(seqs[-1]) + 1, int(befores[-1] + n[-1])
                yield pa.record_batch([some.column("part"), pa.array(seqs), pa.array(befores), some.column("doc_id"), binary(ids, 2 * np.append(0, np.cumsum(n))), pa.nulls(len(n), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"counts": counts.tobytes()}], schema=schema)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of tasks."""
    n = np.zeros(1 << 16, dtype=np.int64)
    for b in batches:
        for x in b.column("counts").to_pylist():
            n += np.frombuffer(x, dtype=np.int64)
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["id", "n"])


def _blocks(rank: np.ndarray, bases: dict[int, int], block_ids: int):
    """Rows that follow one another in the corpus, up to block_ids ids, become a block."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        lean()
        docs: list = []
        ids: list[bytes] = []
        first, last, size = (0, 0, 0), None, 0

        def block() -> pa.RecordBatch:
            control, data = encode_values(rank[np.frombuffer(b"".join(ids), dtype="<u2")])
            part, seq, before = first
            row = {"part": part, "seq": seq, "start": bases[part] + before, "doc_ids": docs, "n_tokens": [len(x) // 2 for x in ids], "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for p, q, before, d, x in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "before", "doc_id", "ids"))):
                if docs and ((p, q - 1) != last or size >= 2 * block_ids):
                    yield block()
                    docs, ids, size = [], [], 0
                if not docs:
                    first = (p, q, before)
                last = (p, q)
                docs.append(d)
                ids.append(x)
                size += len(x)
        if docs:
            yield block()

    return run


def _rows(by_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n_tokens"], dtype=np.int64)
                raw = by_rank[decode_values(r["control"], r["data"], int(n.sum()))].astype("<u4")
                raw = memoryview(raw).cast("B") if len(raw) else b""
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), r["n_tokens"])]
                yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes path/ranks and path/blocks. tokenizer: a file of the tokenizers library; block_ids: ids after which a block ends with its document."""
    spark = session(docs)
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks, tie, key = fan_out(spark), f"{OWN}tie", F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = range_bounds(docs.select(key.alias("key")), "key", tasks, repeats=True)
    upto, under = range_of(key, bounds), range_of(key, bounds, below=True)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(F.lit(1), upto - under))
    dealt = docs.withColumn("part", F.when(upto - under > 1, under + 1 + salt).otherwise(upto).cast("int")).withColumn(tie, F.xxhash64("text"))
    dealt = dealt.repartitionById(tasks, "part").sortWithinPartitions("part", "doc_id", tie).select("part", "doc_id", "text")
    coded = written(dealt.mapInArrow(_ids(tokenizer, end_id), "part int, seq bigint, before bigint, doc_id bigint, ids binary, counts binary"), "token-ids")
    ids = coded.where("part IS NOT NULL").drop("counts")
    del dealt
    release(spark)  # the shuffled texts go before the files are written
    counts = coded.where("counts IS NOT NULL").select("counts").mapInArrow(_count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = counts.select((F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1).alias("rank"), "id", "n")  # at most 65,536 rows
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(1 << 16, dtype="<u2")
    for r in spark.read.parquet(f"{path}/ranks").select("rank", "id").collect():
        rank[r["id"]] = r["rank"]
    sums = ids.groupBy("part").agg(F.max(F.col("before") + (F.octet_length("ids") / 2).cast("bigint")).alias("n")).collect()  # one row a part
    bases, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        bases[r["part"]], total = total, total + r["n"]
    blocks = ids.mapInArrow(_blocks(rank, bases, block_ids), "part int, seq bigint, start bigint, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary")
    named = blocks.withColumn("part", F.lpad(F.col("part").cast("string"), 6, "0"))
    named.write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")
    forget(spark, coded)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], dtype="<u4")
    blocks = spark.read.schema("part int, seq bigint, start bigint, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary").parquet(f"{path}/blocks").select("start", "doc_ids", "n_tokens", "control", "data")
    return blocks.mapInArrow(_rows(by_rank), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs in the file format and reads the files back."""
    spark = session(docs)
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)
