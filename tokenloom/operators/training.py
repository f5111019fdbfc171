"""Training loops with closed-form gradients: a softmax classifier over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..sources.scratch import written
from . import optim


def gradient(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """i, j, v, loss, n: sums of (softmax(x W^T) - onehot)^T x over all rows; each Arrow batch gives one partial sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = np.zeros_like(weights), 0.0, 0
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["label"].to_numpy()
                p = dense.softmax(x @ weights.T)
                loss -= np.log(p[np.arange(len(y)), y]).sum()
                p[np.arange(len(y)), y] -= 1
                total, n = total + p.T @ x, n + len(y)
        i, j = np.indices(weights.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel(), "loss": loss, "n": n})

    parts = rows.select("x", "label").mapInPandas(run, "i int, j int, v double, loss double, n bigint")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def mean_loss(rows: DataFrame, weights: np.ndarray) -> float | None:
    """Mean cross-entropy over all rows under fixed weights, from one partial sum an Arrow batch; None without rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["label"].to_numpy()
                p = dense.softmax(x @ weights.T)
                yield pd.DataFrame({"loss": [-np.log(p[np.arange(len(y)), y]).sum()], "n": [len(y)]})

    parts = rows.select("x", "label").mapInPandas(run, "loss double, n bigint")
    return parts.agg((F.sum("loss") / F.sum("n")).alias("l")).head()["l"]


def train_classifier(rows: DataFrame, classes: int, width: int, steps: int, lr: tuple[float, float, int, int], most_norm: float, valid: DataFrame | None = None, eval_every: int = 1) -> tuple[DataFrame, list[dict]]:
    """The last state and a record a step (iter from 1, train_loss, lr from the step before): gradient, clip, AdamW at the scheduled rate.

    valid: rows whose mean loss under the updated weights is logged as valid_loss in every eval_every-th step; null in the others.
    Driver data is one weight matrix; rows stay distributed.
    """
    spark = rows.sparkSession
    zero = spark.range(classes).select(F.lit("w").alias("name"), F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"), F.lit(0.0).alias("v"))
    state, log = optim.fresh(zero), []
    weights = np.zeros((classes, width))
    for it in range(steps):
        got = written(gradient(rows, weights), "gradient")
        loss = got.agg((F.max("loss") / F.max("n")).alias("l")).head()["l"]
        grads = got.select(F.lit("w").alias("name"), "i", "j", (F.col("v") / F.col("n")).alias("v"))
        rate = spark.range(1).select(optim.cosine_lr(F.lit(it), *lr).alias("r")).head()["r"]
        state = written(optim.adamw(state, optim.clip(grads, most_norm), it + 1, lr=rate), "state")
        for r in state.select("i", "j", "v").collect():  # classes * width rows
            weights[r["i"], r["j"]] = r["v"]
        checked = valid is not None and (it + 1) % eval_every == 0
        log.append({"iter": it + 1, "train_loss": loss, "valid_loss": mean_loss(valid, weights) if checked else None, "lr": rate})
    return state, log
