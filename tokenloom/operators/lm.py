"""Language-model training over token windows: bigram tables in SQL, a Transformer by reverse mode, AdamW steps for both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gradients, init
from ..sources.scratch import written
from . import optim
from .tensor import softmax_over

#: Sequences that a kernel takes at once.
AT_ONCE = 256


def pair_rows(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """i, j, n: how often token j follows token i; all that a bigram model learns from."""
    pairs = F.transform(F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))), lambda t, k: F.struct(t.alias("i"), F.get(F.col(ids), k + 1).alias("j")))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.j").agg(F.count("*").alias("n"))


def bigram_log(counts: DataFrame, state: DataFrame) -> DataFrame:
    """i, j, n, p: counts (0 where there are none) beside the model's probabilities, for tables of vocabulary squared rows."""
    p = softmax_over(state.select("i", "j", "v"), ["i"], "v")
    return p.join(counts, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"), "p")


def bigram_loss(counts: DataFrame, state: DataFrame) -> float | None:
    """Mean cross-entropy of the counted pairs; None without pairs."""
    return bigram_log(counts, state).agg((-F.sum(F.when(F.col("n") > 0, F.col("n") * F.log("p"))) / F.sum("n")).alias("l")).head()["l"]


def bigram_gradient(counts: DataFrame, state: DataFrame) -> DataFrame:
    """name, i, j, v: (row count * p - n) / pairs of every cell, without going back to the texts."""
    each = bigram_log(counts, state)
    rows = each.groupBy("i").agg(F.sum("n").alias("row"))
    total = rows.agg(F.sum("row").alias("total"))
    return each.join(rows, "i").crossJoin(F.broadcast(total)).select(F.lit("w").alias("name"), "i", "j", ((F.col("row") * F.col("p") - F.col("n")) / F.col("total")).alias("v"))  # total: one row


def steps(
    spark: SparkSession, state: DataFrame, many: int, lr: tuple[float, float, int, int], most_norm: float, gradient: Callable[[DataFrame], tuple[DataFrame, float | None]], valid: Callable[[DataFrame], float | None] | None = None, eval_every: int = 1
) -> tuple[DataFrame, list[dict]]:
    """The state after many steps of gradient, clipping and AdamW at the scheduled rate, and a record a step.

    gradient gives a state's gradients and its loss; valid the loss on held-out rows, logged in every eval_every-th step.
    """
    log = []
    for it in range(many):
        grads, loss = gradient(state)
        rate = spark.range(1).select(optim.cosine_lr(F.lit(it), *lr).alias("r")).head()["r"]
        state = written(optim.adamw(state, optim.clip(grads, most_norm), it + 1, lr=rate), "state")
        checked = valid is not None and (it + 1) % eval_every == 0
        log.append({"iter": it + 1, "train_loss": loss, "valid_loss": valid(state) if checked else None, "lr": rate})
    return state, log


def train_bigram(rows: DataFrame, vocab: int, many: int, lr: tuple[float, float, int, int], most_norm: float, valid: DataFrame | None = None, eval_every: int = 1) -> tuple[DataFrame, list[dict]]:
    """The state and log of a bigram model of rows (ids); texts are read once, steps work on vocabulary squared cells."""
    spark = rows.sparkSession
    counts, held = written(pair_rows(rows), "pairs"), written(pair_rows(valid), "pairs") if valid is not None else None
    zero = spark.range(vocab).select(F.lit("w").alias("name"), F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(vocab - 1))).alias("j"), F.lit(0.0).alias("v"))

    def gradient(state: DataFrame) -> tuple[DataFrame, float | None]:
        return bigram_gradient(counts, state), bigram_loss(counts, state)

    return steps(spark, optim.fresh(zero), many, lr, most_norm, gradient, (lambda state: bigram_loss(held, state)) if held is not None else None, eval_every)


def initial(spark: SparkSession, vocab: int, d: int, ff: int, layers: int, seed: int) -> DataFrame:
    """name, i, j, v: truncated normal weights (deviation by the matrix's shape, 1 for the embedding), gains of one."""
    shapes = [("embedding", vocab, d), ("head", vocab, d), ("ln_final", 1, d)]
    for n in range(layers):
        shapes += [(f"layers.{n}.{c}", d, d) for c in "qkvo"] + [(f"layers.{n}.w1", ff, d), (f"layers.{n}.w3", ff, d), (f"layers.{n}.w2", d, ff), (f"layers.{n}.ln1", 1, d), (f"layers.{n}.ln2", 1, d)]
    stds = [(n, r, c, 1.0 if n == "embedding" else init.linear_std(r, c)) for n, r, c in shapes]
    table = spark.createDataFrame(stds, "name string, rows int, columns int, std double")
    cells = table.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    drawn = init.truncated_normal(init.uniform(seed, F.col("name"), F.col("i"), F.col("j")), F.col("std"))
    return cells.select("name", "i", "j", F.when(F.col("name").contains("ln"), F.lit(1.0)).otherwise(drawn).alias("v"))


def matrices(state: DataFrame) -> dict[str, np.ndarray]:
    """A parameter table as matrices on the driver; its size is the model's."""
    out = {}
    for name, cells in state.select("name", "i", "j", "v").toPandas().groupby("name"):
        m = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1))
        m[cells["i"], cells["j"]] = cells["v"]
        out[name] = m
    return out


def lm_sums(windows: DataFrame, params: dict[str, np.ndarray], heads: int, with_gradients: bool = True) -> DataFrame:
    """name, i, j, v, loss, n: gradients, losses and targets summed over all windows (x, y of one length); one partial sum a task."""
    shared = windows.sparkSession.sparkContext.broadcast(params)  # of the size of the model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        total, loss, n = {k: np.zeros_like(v) for k, v in w.items()}, 0.0, 0
        for pdf in batches:
            for at in range(0, len(pdf), AT_ONCE):
                x, y = (np.array(pdf[c].iloc[at : at + AT_ONCE].tolist()) for c in ("x", "y"))
                more, grads = gradients.loss_and_gradients(x, y, w, heads, gradients=with_gradients)
                loss, n = loss + more, n + y.size
                for k, g in grads.items():
                    total[k] += g
        if n and not with_gradients:
            yield pd.DataFrame({"name": ["loss"], "i": [0], "j": [0], "v": [0.0], "loss": [loss], "n": [n]})
        elif n:
            for k, g in total.items():
                i, j = np.indices(g.shape)
                yield pd.DataFrame({"name": k, "i": i.ravel(), "j": j.ravel(), "v": g.ravel(), "loss": loss, "n": n})

    parts = windows.select("x", "y").mapInPandas(run, "name string, i int, j int, v double, loss double, n bigint")
    return parts.groupBy("name", "i", "j").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def lm_gradient(windows: DataFrame, state: DataFrame, heads: int) -> tuple[DataFrame, float | None]:
    """Gradients of the mean loss (name, i, j, v), and that loss; None without windows."""
    got = written(lm_sums(windows, matrices(state), heads), "gradient")
    return got.select("name", "i", "j", (F.col("v") / F.col("n")).alias("v")), got.agg((F.max("loss") / F.max("n")).alias("l")).head()["l"]


def lm_loss(windows: DataFrame, state: DataFrame, heads: int) -> float | None:
    return lm_sums(windows, matrices(state), heads, with_gradients=False).agg((F.sum("loss") / F.sum("n")).alias("l")).head()["l"]


def train_lm(windows: DataFrame, params: DataFrame, heads: int, many: int, lr: tuple[float, float, int, int], most_norm: float, valid: DataFrame | None = None, eval_every: int = 1) -> tuple[DataFrame, list[dict]]:
    """The state and log of a Transformer trained on windows (x, y); the driver holds the model, windows stay distributed."""
    check = (lambda state: lm_loss(valid, state, heads)) if valid is not None else None
    return steps(windows.sparkSession, optim.fresh(params), many, lr, most_norm, lambda state: lm_gradient(windows, state, heads), check, eval_every)
