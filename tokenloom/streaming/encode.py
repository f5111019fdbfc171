"""Streaming: each arriving row is encoded by itself; token counts run along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe import Tokenizer, encode, token_parts
from ..sources.scratch import scratch_path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a parquet table that is a folder or a single file."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def encoded(stream: DataFrame, tok: Tokenizer, key: str = "doc_id") -> DataFrame:
    """key, ids of each row: stateless, so it needs no watermark and restarts from its checkpoint."""
    return encode(stream, tok, key)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Runs all that is available into a parquet sink and reads it: exactly once by the sink's commit log."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_counts(stream: DataFrame, tok: Tokenizer) -> DataFrame:
    """token_id, n over all rows so far, for complete or update mode; workers count what they encode, so no row is one id."""
    return token_parts(stream, tok).groupBy("token_id").agg(F.sum("n").alias("n"))
