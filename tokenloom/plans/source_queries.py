"""Queries of sources, sinks and streaming: tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bpe
from ..sources import files, state, vocab
from ..sources.scratch import scratch_path, written
from ..streaming import encode as stream
from . import text_queries as T

DELIMITER = "<|endoftext|>"


def _text_files(spark, d) -> str:
    """documents as text files, a delimiter after each."""
    path = scratch_path(spark, "text")
    T.docs(spark, d).select(F.concat("text", F.lit(DELIMITER)).alias("value")).write.option("lineSep", "\n").text(path)
    return path


def text_records(spark, d):
    r = files.records(spark, _text_files(spark, d), DELIMITER).select(F.regexp_replace("value", "^\n", "").alias("value"))
    return r.where("value != ''").groupBy(F.md5("value").alias("text_md5")).agg(F.count("*").alias("n"))


def text_lines(spark, d):
    r = files.lines(spark, _text_files(spark, d)).select(F.replace("value", F.lit(DELIMITER), F.lit("")).alias("value"))
    return r.groupBy("value").agg(F.count("*").alias("n")).select(F.md5("value").alias("line_md5"), "n")


def whole_text(spark, d):
    path = scratch_path(spark, "whole")
    T.docs(spark, d).select(F.concat("doc_id", F.lit("|"), F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("value"), (F.col("doc_id") % 16).alias("part")).repartition("part").sortWithinPartitions("part", "value").write.partitionBy("part").option("lineSep", "\r").text(path)
    t = files.whole_files(spark, path)
    return t.agg(F.sum(F.length("value")).cast("bigint").alias("n_chars"), F.sum(F.length(F.regexp_replace("value", "[^\n]", ""))).cast("bigint").alias("n_lines"))


def chunked_counts(spark, d):
    """Pre-token counts over delimiter-aligned splits of text files: partial sums in each, then one total."""
    r = files.records(spark, _text_files(spark, d), DELIMITER).select(F.regexp_replace("value", "^\n", "").alias("text"))
    return bpe.pretoken_counts(r)


def chunk_boundaries(spark, d):
    """Byte offsets that cut each text into at most four chunks at line feeds."""
    return T.docs(spark, d).select("doc_id", files.boundaries(F.encode("text", "UTF-8"), 4, "\n").alias("b")).select("doc_id", F.array_join(F.col("b").cast("array<string>"), ",").alias("boundaries"))


def file_chunks(spark, d):
    """All texts as records of 16 files, each cut into eight chunks at delimiters: where chunks start."""
    path = scratch_path(spark, "files")
    rows = T.docs(spark, d).where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit(DELIMITER)).alias("value"), (F.col("doc_id") % 16).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("value", "part").write.partitionBy("part").text(path)
    cut = files.file_boundaries(spark, path, 8, DELIMITER).select(F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"), F.posexplode("boundaries").alias("chunk", "start"))
    return cut


_WIDE = len(DELIMITER) + 1
FILE_CHUNKS_SQL = f"""WITH r AS (SELECT doc_id % 16 AS part, strlen(text) + {_WIDE} AS n, doc_id FROM documents WHERE text IS NOT NULL),
e AS (SELECT part, sum(n) OVER (PARTITION BY part ORDER BY doc_id) - {_WIDE} AS e FROM r), z AS (SELECT part, sum(n) AS size FROM r GROUP BY part),
b AS (SELECT part, coalesce(min(e), any_value(size)) AS b FROM (SELECT *, i * (size // 8) AS at_least FROM z, range(1, 8) t(i)) LEFT JOIN e USING (part) WHERE e >= at_least OR e IS NULL GROUP BY part, i),
a AS (SELECT part, b FROM b UNION SELECT part, 0 FROM z UNION SELECT part, size FROM z)
SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY b) - 1 AS INT) AS chunk, CAST(b AS BIGINT) AS start FROM a"""


def vocab_roundtrip(spark, d):
    merges = written(bpe.train(T.docs(spark, d), T.MERGES), "merges")
    path = scratch_path(spark, "vocab")
    vocab.save(bpe.vocabulary(merges, [DELIMITER]), merges, path)
    v, _ = vocab.load(spark, path)
    return v


def merges_roundtrip(spark, d):
    merges = written(bpe.train(T.docs(spark, d), T.MERGES), "merges")
    path = scratch_path(spark, "vocab")
    vocab.save(bpe.vocabulary(merges), merges, path)
    return vocab.load(spark, path)[1]


def letter_import(spark, d):
    """Vocabulary and merges written in byte letters (one JSON object; a line a merge), imported with a special token appended."""
    merges = written(bpe.train(T.docs(spark, d), T.MERGES), "merges")
    path = scratch_path(spark, "letters")
    tokens = bpe.vocabulary(merges).groupBy("token").agg(F.min("token_id").alias("token_id"))  # an object has a token once
    entries = F.map_from_entries(F.collect_list(F.struct(vocab.to_letters(F.col("token")), "token_id")))  # bounded by the vocabulary
    tokens.agg(F.to_json(entries).alias("value")).write.text(f"{path}/vocab")
    line = F.concat_ws(" ", vocab.to_letters(F.col("l")), vocab.to_letters(F.col("r"))).alias("value")
    merges.coalesce(1).sortWithinPartitions("rank").select(line).write.text(f"{path}/merges")
    v, m = vocab.import_letters(spark, f"{path}/vocab", f"{path}/merges", [DELIMITER])
    kinds = v.select(F.lit("token").alias("kind"), F.col("token_id").alias("at"), F.col("token").alias("value"))
    return kinds.unionByName(m.select(F.lit("merge").alias("kind"), F.col("rank").alias("at"), F.concat_ws(" ", "l", "r").alias("value")))


def byte_letter_codec(spark, d):
    words = bpe.pretoken_counts(T.docs(spark, d)).select("word", F.hex(F.encode("word", "UTF-8")).alias("h"))
    coded = words.select("word", "h", vocab.to_letters(F.col("h")).alias("letters"))
    return coded.select("word", F.length("letters").alias("n_letters"), (vocab.from_letters(F.col("letters")) == F.col("h")).alias("same"))


def token_array(spark, d):
    rows = bpe.encode(T.docs(spark, d), T.tokenizer(spark, d))
    path = scratch_path(spark, "tokens")
    state.save_tokens(rows, path)
    t = state.load_tokens(spark, path)
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("token_id") * (F.col("pos") % 1000 + 1)).alias("checksum"))


def streaming_encode(spark, d):
    s = stream.encoded(stream.read_documents(spark, f"{d}/documents.parquet"), T.tokenizer(spark, d))
    return T._checked(stream.finished(s, "stream"))


def streaming_token_counts(spark, d):
    s = stream.running_counts(stream.read_documents(spark, f"{d}/documents.parquet"), T.tokenizer(spark, d))
    name = "token_counts_" + scratch_path(spark, "x")[-8:]
    s.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def distinct_boundaries(spark, d):
    """Set operations: byte-length boundaries of documents, without duplicates, less those of labelled ones."""
    docs = T.docs(spark, d).select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    labelled = docs.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.select("size").distinct().exceptAll(labelled.select("size").distinct())


QUERIES = {
    "text_records": text_records, "text_lines": text_lines, "whole_text": whole_text, "chunked_counts": chunked_counts, "chunk_boundaries": chunk_boundaries, "file_chunks": file_chunks, "vocab_roundtrip": vocab_roundtrip, "merges_roundtrip": merges_roundtrip, "letter_import": letter_import, "byte_letter_codec": byte_letter_codec,
    "token_array": token_array, "streaming_encode": streaming_encode, "streaming_token_counts": streaming_token_counts, "distinct_boundaries": distinct_boundaries,
}
ORACLES = {
    "text_records": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1",
    "text_lines": "SELECT md5(l || chr(10)) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1",
    "whole_text": "SELECT CAST(sum(length(text) + length(CAST(doc_id AS VARCHAR)) + 2) AS BIGINT) AS n_chars, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM documents",
    "chunked_counts": T.G.WORDS,
    "file_chunks": FILE_CHUNKS_SQL,
    "chunk_boundaries": """WITH l AS (SELECT doc_id, strlen(text) AS size, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT doc_id, size, sum(strlen(l) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM l),
b AS (SELECT doc_id, min(pos) AS cut FROM p, range(1, 4) t(i) WHERE pos >= i * (size // 4) GROUP BY doc_id, i UNION SELECT doc_id, 0 FROM documents UNION SELECT doc_id, strlen(text) FROM documents)
SELECT doc_id, string_agg(CAST(CAST(cut AS BIGINT) AS VARCHAR), ',' ORDER BY cut) AS boundaries FROM b GROUP BY doc_id""",
    "vocab_roundtrip": T.BPE_VOCABULARY_SQL,
    "merges_roundtrip": T.BPE_TRAIN_SQL.replace(", l, r, n FROM m", ", l, r FROM m"),
    "letter_import": f"""{T.G.bpe_states(T.MERGES)}, m AS ({T._MERGES}),
v AS (SELECT min(i) AS i, t FROM (SELECT b AS i, printf('%02X', b) AS t FROM range(256) r(b) UNION ALL SELECT 256 + rank, l || r FROM m) GROUP BY t)
SELECT 'token' AS kind, CAST(i AS INT) AS at, t AS value FROM v UNION ALL SELECT 'token', CAST(count(*) AS INT), hex(encode('{DELIMITER}')) FROM v
UNION ALL SELECT 'merge', CAST(rank AS INT), l || ' ' || r FROM m""",
    "byte_letter_codec": f"WITH w AS ({T.G.WORDS}) SELECT word, CAST(strlen(word) AS INT) AS n_letters, true AS same FROM w",
    "token_array": f"{T.ENCODED} SELECT doc_id, count(*) AS n, CAST(sum(id * ((p - 1) % 1000 + 1)) AS BIGINT) AS checksum FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM e) GROUP BY doc_id",
    "streaming_encode": T.BPE_ENCODE_SQL,
    "streaming_token_counts": f"{T.ENCODED} SELECT id AS token_id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM e) GROUP BY id",
    "distinct_boundaries": "SELECT DISTINCT CAST(strlen(text) AS BIGINT) AS size FROM documents EXCEPT SELECT CAST(strlen(text) AS BIGINT) FROM documents JOIN labels USING (doc_id)",
}
