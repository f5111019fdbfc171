"""Relational tensor operators: matrices as (i, j, v) rows, sequences as keyed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dense


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a (i, k, v) times b (k, j, v): a join on k and a sum with partial aggregation."""
    left, right = a.select("i", "k", F.col("v").alias("x")), b.select("k", "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def embedding_lookup(ids: DataFrame, table: DataFrame) -> DataFrame:
    """ids (..., token_id) with the row of table (token_id, embedding) each points to; unknown ids drop out."""
    return ids.join(table, "token_id")


def softmax_over(rows: DataFrame, keys: list[str], value: str, out: str = "p") -> DataFrame:
    """Softmax over any dimension of long rows: all rows that share keys."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return rows.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def cross_entropy(rows: DataFrame, logits: str, target: str) -> DataFrame:
    """One row: the mean of log-sum-exp minus the target's logit."""
    top = F.array_max(F.col(logits))
    lse = top + F.log(F.aggregate(F.transform(F.col(logits), lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))
    return rows.agg(F.avg(lse - F.get(F.col(logits), F.col(target))).alias("loss"), F.count("*").alias("n"))


def param_count(params: DataFrame) -> DataFrame:
    """Rows of a parameter table (name, i, j, v), per name and in all."""
    return params.groupBy("name").agg(F.count("*").alias("n")).unionByName(params.agg(F.count("*").alias("n")).select(F.lit("total").alias("name"), "n"))


def over_sequences(rows: DataFrame, kernel, width: int) -> DataFrame:
    """b, p, k, v: kernel((positions, d)) -> (positions, width) for each sequence b of rows (b, p, x), which is short by contract (a context length)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        y = kernel(np.stack([np.asarray(x, dtype=np.float64) for x in pdf["x"]]))
        n = len(pdf)
        return pd.DataFrame({"b": pdf["b"].iloc[0], "p": np.repeat(pdf["p"].to_numpy(), width), "k": np.tile(np.arange(width), n), "v": y.reshape(-1)})

    return rows.groupBy("b").applyInPandas(run, "b bigint, p bigint, k bigint, v double")


def dense_rows(rows: DataFrame, kernel, key: str) -> DataFrame:
    """key, y: kernel on a matrix of the rows of each Arrow batch; weights are in the kernel, so their size is that of the model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = kernel(np.stack([np.asarray(x, dtype=np.float64) for x in pdf["x"]]))
                yield pd.DataFrame({key: pdf[key], "y": list(y)})

    return rows.select(key, "x").mapInPandas(run, f"{key} bigint, y array<double>")


def swiglu_rows(rows: DataFrame, w: dict[str, np.ndarray], key: str, kind: str = "swiglu") -> DataFrame:
    return dense_rows(rows, lambda x: dense.feed_forward(x, w, kind), key)


def long(rows: DataFrame, column: Column | str, *keys: str) -> DataFrame:
    """keys, k, v of an array column."""
    c = F.col(column) if isinstance(column, str) else column
    return rows.select(*keys, F.posexplode(c).alias("k", "v"))
