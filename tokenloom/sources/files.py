"""Text sources: whole files, lines, delimiter records, chunk boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import without_broken_bytes


def whole_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """value: each file's text, with CRLF and CR read as LF. strict: bytes that are not UTF-8 raise an error, else they become U+FFFD."""
    raw = F.col("value")
    text = F.validate_utf8(raw) if strict else F.make_valid_utf8(raw)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(text, "\r\n?", "\n").alias("value"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of all files, each with its line feed put back."""
    return spark.read.text(path, lineSep="\n").select(F.concat("value", F.lit("\n")).alias("value"))


def records(spark: SparkSession, path: str, delimiter: str = "<|endoftext|>", ignore: bool = False) -> DataFrame:
    """value: the documents between delimiters; Spark's splits are aligned to them, so none is cut. ignore: bytes that are not UTF-8 are left out."""
    rows = spark.read.text(path, lineSep=delimiter)
    return rows.select(without_broken_bytes(F.col("value")).alias("value")) if ignore else rows


def chunk_boundaries(path: str, chunks: int, delimiter: bytes, window: int = 4096) -> list[int]:
    """Ascending offsets that cut a local file into at most so many chunks, each inner one at a delimiter's start.

    Guesses are evenly spaced and move forward to the next delimiter, or the end. Windows overlap by the
    delimiter's length less one, so one that lies across two of them is found too.
    """
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        found = {0, size}
        for i in range(1, chunks):
            at = i * (size // chunks)
            f.seek(at)
            held, base = b"", at
            while True:
                more = f.read(window)
                if not more:
                    found.add(size)
                    break
                held += more
                hit = held.find(delimiter)
                if hit >= 0:
                    found.add(base + hit)
                    break
                done = max(0, len(held) - len(delimiter) + 1)
                base, held = base + done, held[done:]
        return sorted(found)


def boundaries(content: Column, chunks: int, delimiter: str) -> Column:
    """chunk_boundaries of bytes in a column, as an ascending array<bigint>: for files on any file system, read as binaryFile.

    The delimiter is ASCII; null gives null.
    """
    plain = F.decode(content, "ISO-8859-1")  # one character a byte
    size = F.length(plain).cast("bigint")
    at = lambda i: F.call_function("locate", F.lit(delimiter), plain, (i * F.floor(size / chunks) + 1).cast("int"))
    inner = [F.when(at(i) > 0, at(i).cast("bigint") - 1).otherwise(size) for i in range(1, chunks)]
    return F.when(content.isNotNull(), F.array_sort(F.array_distinct(F.array(F.lit(0).cast("bigint"), size, *inner))))


def file_boundaries(spark: SparkSession, path: str, chunks: int, delimiter: str) -> DataFrame:
    """path, boundaries of each file, of any size and on any file system; Spark gives no row for an empty one.

    Files are read in the splits of the text source, aligned to the delimiter; a split's records give the places of their delimiters, a row
    a split what lies before it. So no file is a row, and what is grouped by file is a few numbers a split or a chunk. A delimiter that
    overlaps itself is found as the source finds it.
    """
    wide = len(delimiter.encode())
    file, at = "_metadata.file_path", "_metadata.file_block_start"
    rows = spark.read.text(path, lineSep=delimiter).select(F.col(file).alias("path"), F.col(at).alias("split"), F.col("_metadata.file_size").alias("size"), (F.octet_length("value") + wide).cast("bigint").alias("n"), F.monotonically_increasing_id().alias("row"))
    splits = rows.groupBy("path", "size", "split").agg(F.sum("n").alias("all"))
    files = Window.partitionBy("path").orderBy("split")
    whole = Window.partitionBy("path")
    splits = splits.select("path", "size", "split", (F.sum("all").over(files) - F.col("all")).alias("before"), F.sum("all").over(whole).alias("total"))
    inside = Window.partitionBy("path", "split").orderBy("row")
    ends = rows.withColumn("upto", F.sum("n").over(inside)).drop("size").join(splits, ["path", "split"])
    end, start = F.col("before") + F.col("upto") - wide, F.col("before") + F.col("upto") - F.col("n")  # of a record; its delimiter begins at its end
    step = F.floor(F.col("size") / chunks)
    last = F.when(step == 0, F.lit(chunks - 1)).otherwise(F.least(F.lit(chunks - 1), F.floor(end / F.greatest(step, F.lit(1)))))
    first = F.when(step == 0, F.when(start == 0, 1).otherwise(chunks)).when(start == 0, 1).otherwise(F.floor((start - wide) / F.greatest(step, F.lit(1))) + 1)
    cut = (end < F.col("size")) & (first <= last)  # the last record may have no delimiter
    found = ends.groupBy("path", "size").agg(F.collect_set(F.when(cut, end)).alias("found"))
    inner = F.concat("found", F.array(F.lit(0).cast("bigint"), F.col("size")))
    return found.select("path", F.array_sort(F.array_distinct(inner)).alias("boundaries"))
