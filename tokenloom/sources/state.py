"""Checkpoints, metrics logs and token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "iter int, train_loss double, valid_loss double, lr double, elapsed_time double"


def save_checkpoint(state: DataFrame, iteration: int, path: str) -> None:
    """state (name, i, j, v, m, s) under path/iter=N; a row of path/done is written after it, so a broken write is never read."""
    state.write.mode("overwrite").parquet(f"{path}/iter={iteration}")
    state.sparkSession.range(1).select(F.lit(iteration).alias("iteration")).coalesce(1).write.mode("append").parquet(f"{path}/done")


def load_checkpoint(spark: SparkSession, path: str, iteration: int | None = None) -> tuple[DataFrame, int]:
    """The state and number of an iteration, by default the latest that was finished."""
    if iteration is None:
        iteration = spark.read.parquet(f"{path}/done").agg(F.max("iteration").alias("n")).head()["n"]
    return spark.read.parquet(f"{path}/iter={iteration}"), iteration


def append_log(spark: SparkSession, records: list[dict], path: str) -> None:
    fields = [f.split(" ")[0] for f in LOG.split(", ")]
    spark.createDataFrame([tuple(r.get(f) for f in fields) for r in records], LOG).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def save_tokens(rows: DataFrame, path: str, limit: int = 1 << 16) -> None:
    """rows (doc_id, ids) as they are, a row a document; an id that doesn't fit the narrow type raises an error."""
    low, high = F.array_min("ids"), F.array_max("ids")
    wrong = F.when(low < 0, low).otherwise(high).cast("string")
    wide = F.raise_error(F.concat(F.lit("token id out of range: "), wrong)).cast("array<int>")
    rows.select("doc_id", F.when((low < 0) | (high >= limit), wide).otherwise(F.col("ids")).alias("ids")).write.parquet(path)


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, token_id: a row a token, made as the stored arrays are read."""
    return spark.read.schema("doc_id bigint, ids array<int>").parquet(path).select("doc_id", F.posexplode("ids").alias("pos", "token_id"))
