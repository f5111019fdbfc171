"""Sampling operators over long rows (b, token, logit) or (b, token, p); ties go to the smaller token."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dense


def temperature(rows: DataFrame, t: float) -> DataFrame:
    if t <= 0:
        raise ValueError("temperature must be positive")
    return rows.withColumn("logit", F.col("logit") / F.lit(float(t)))


def probabilities(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("b")
    e = rows.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def top_p(rows: DataFrame, mass: float) -> DataFrame:
    """Keeps tokens whose cumulative probability, in falling order, is at most mass, and always the first; renormalised."""
    order = Window.partitionBy("b").orderBy(F.col("p").desc(), "token")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("cum", F.sum("p").over(upto)).withColumn("rn", F.row_number().over(order)).where((F.col("cum") <= mass) | (F.col("rn") == 1))
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("b"))).drop("cum", "rn")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """Keeps logits that reach the k-th largest, ties included."""
    return rows.withColumn("r", F.rank().over(Window.partitionBy("b").orderBy(F.col("logit").desc()))).where(F.col("r") <= k).drop("r")


def draw(rows: DataFrame, uniforms: DataFrame) -> DataFrame:
    """b, token: the first token, by id, whose cumulative probability reaches the given u (b, u); the last if none does."""
    upto = Window.partitionBy("b").orderBy("token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = rows.withColumn("cum", F.sum("p").over(upto)).join(uniforms, "b")
    return cum.groupBy("b").agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("u"), F.col("token"))), F.max("token")).alias("token"))


def generate(prompts: DataFrame, best: DataFrame, new: int, end: int | None = None, keep_end: bool = True) -> DataFrame:
    """b, ids: greedy continuation by a next-token table best (token, nxt), one join a token; a sequence stops at end."""
    rows = prompts.select("b", "ids", F.lit(False).alias("done"))
    for _ in range(new):
        step = rows.withColumn("token", F.element_at("ids", -1)).join(best, "token", "left")
        stop = F.col("done") | F.col("nxt").isNull()
        ends = F.lit(False) if end is None else F.coalesce(F.col("nxt") == end, F.lit(False))
        add = ~stop & (F.lit(keep_end) | ~ends)
        rows = step.select("b", F.when(add, F.array_append("ids", F.col("nxt"))).otherwise(F.col("ids")).alias("ids"), (stop | ends).alias("done"))
    return rows.select("b", "ids")


def generate_lm(w: dict, heads: int, prompt: list[int], new: int, context: int, uniforms: Callable[[int], float], t: float = 1.0, p: float | None = None, k: int | None = None, end: int | None = None, keep_end: bool = True, return_prompt: bool = True) -> list[int]:
    """Continuation by the Transformer: last context ids, temperature, top-k, top-p, inverse-CDF draw with supplied uniforms.

    Up to context ids a step reads the newest only. Beyond, the first id leaves and with it what later ones took from it, so the
    window is read again.
    """
    ids, model = list(prompt), dense.Decoder(w, heads)
    for step in range(new):
        if len(ids) > context:
            model.forget()
        logits = model.read(np.array(ids[-context:][model.length :])) / t
        if k is not None:
            logits = np.where(logits >= np.sort(logits)[-min(k, len(logits))], logits, -np.inf)
        probs = dense.softmax(logits)
        if p is not None:
            order = np.lexsort((np.arange(len(probs)), -probs))
            keep = np.cumsum(probs[order]) <= p
            keep[0] = True
            chosen = np.zeros_like(probs)
            chosen[order[keep]] = probs[order[keep]]
            probs = chosen / chosen.sum()
        token = int(min(np.searchsorted(np.cumsum(probs), uniforms(step), side="right"), len(probs) - 1))
        if token == end:
            if keep_end:
                ids.append(token)
            break
        ids.append(token)
    return ids if return_prompt else ids[len(prompt) :]


def generate_lm_rows(prompts: DataFrame, w: dict, heads: int, **options) -> DataFrame:
    """b, ids for prompts (b, ids): each row continued by generate_lm; row b's draws come from a congruential generator started at b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [generate_lm(w, heads, list(ids), uniforms=lambda s, b=b: ((b * 7919 + s * 104729 + 13) % 1000) / 1000.0, **options) for b, ids in zip(pdf["b"], pdf["ids"])]
            yield pd.DataFrame({"b": pdf["b"], "ids": out})

    return prompts.select("b", "ids").mapInPandas(run, "b bigint, ids array<int>")
