"""Attention as joins and sums over long rows (b, h, p, k, v): batch, head, position, feature, value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MASKED = -1e6  # score of a masked pair in the tiled contract


def rows_of(rows: DataFrame, column: str = "x") -> DataFrame:
    """(b, h, p, x array) to long rows."""
    return rows.select("b", "h", "p", F.posexplode(column).alias("k", "v"))


def scores(q: DataFrame, k: DataFrame, causal: bool = False, mask: DataFrame | None = None, soft: bool = False) -> DataFrame:
    """b, h, p, s, score for array rows q and k (b, h, p, x): one equi-join on (b, h), the group being one sequence.

    mask (p, s): only these pairs attend. soft: masked pairs stay, with score MASKED.
    """
    right = k.select("b", "h", F.col("p").alias("s"), F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, c: a * c), F.lit(0.0), lambda a, v: a + v)
    pairs = q.join(right, ["b", "h"])
    if causal and not soft:
        pairs = pairs.where("s <= p")
    out = pairs.select("b", "h", "p", "s", (dot / F.sqrt(F.size("x").cast("double"))).alias("score"))
    if soft and causal:
        out = out.withColumn("score", F.when(F.col("s") <= F.col("p"), F.col("score")).otherwise(F.lit(MASKED)))
    return out.join(F.broadcast(mask), ["p", "s"]) if mask is not None else out  # a mask has context length squared rows at most


def attend(score: DataFrame, v: DataFrame) -> DataFrame:
    """b, h, p, k, v: softmax over s, then the weighted sum of v (b, h, p, x). A fully masked row gives no row."""
    w = Window.partitionBy("b", "h", "p")
    e = score.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    weights = e.withColumn("w", F.col("e") / F.sum("e").over(w)).select("b", "h", "p", "s", "w")
    values = v.select("b", "h", F.col("p").alias("s"), F.posexplode("x").alias("k", "val"))
    return weights.join(values, ["b", "h", "s"]).groupBy("b", "h", "p", "k").agg(F.sum(F.col("w") * F.col("val")).alias("v"))


def tiles(rows: DataFrame, size: int, out: str) -> DataFrame:
    """b, h, tile and the rows of each tile, in order of p; a tile holds size positions at most."""
    own = F.struct("p", *[c for c in rows.columns if c not in ("b", "h", "p")])
    return rows.groupBy("b", "h", F.floor(F.col("p") / size).alias("tile")).agg(F.sort_array(F.collect_list(own)).alias(out))


def _tile_pairs(queries: DataFrame, keys: DataFrame, size: int, causal: bool) -> DataFrame:
    """Tiles of queries (qs) beside tiles of keys (ks) of the same sequence and head; causal: none whose pairs are all masked."""
    left, right = tiles(queries, size, "qs"), tiles(keys, size, "ks").withColumnRenamed("tile", "of")
    pairs = left.join(right, ["b", "h"])
    return (pairs.where("of <= tile") if causal else pairs).select("b", "h", "qs", "ks")


def _matrices(cell, *names: str) -> list[np.ndarray]:
    return [np.array([r[n] for r in cell], dtype=np.float64) for n in names]


def _scores(q: np.ndarray, k: np.ndarray, qp: np.ndarray, kp: np.ndarray, causal: bool) -> np.ndarray:
    s = q @ k.T / np.sqrt(q.shape[1])
    return np.where(kp[None, :] <= qp[:, None], s, MASKED) if causal else s


def _over_pairs(pairs: DataFrame, kernel: Callable[[list, list], Iterator[tuple]], columns: list[str], shape: str) -> DataFrame:
    """b, h and what kernel yields for the rows of two tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(b, h, *r) for b, h, qs, ks in zip(pdf["b"], pdf["h"], pdf["qs"], pdf["ks"]) for r in kernel(qs, ks)]
            yield pd.DataFrame(out, columns=["b", "h", *columns])

    return pairs.mapInPandas(run, f"b {dict(pairs.dtypes)['b']}, h {dict(pairs.dtypes)['h']}, {shape}")


def tiled(q: DataFrame, k: DataFrame, v: DataFrame, tile: int, causal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Output (b, h, p, k, v) and log-sum-exp (b, h, p, lse), from partial (max, sum, output) of each pair of tiles.

    A task sees one tile of queries and one of keys at a time, so no score is ever a row; the partials merge by
    rescaling, in any order.
    """
    done = _forward(q, k, v, tile, causal)
    return done.select("b", "h", "p", F.posexplode("o").alias("k", "v")), done.select("b", "h", "p", "lse")


def _forward(q: DataFrame, k: DataFrame, v: DataFrame, tile: int, causal: bool) -> DataFrame:
    """b, h, p, o (array) and lse."""

    def partial(qs: list, ks: list) -> Iterator[tuple]:
        (qp, x), (kp, y, val) = _matrices(qs, "p", "x"), _matrices(ks, "p", "x", "y")
        s = _scores(x, y, qp, kp, causal)
        top = s.max(axis=1)
        e = np.exp(s - top[:, None])
        yield from zip(qp.astype(np.int64).tolist(), top.tolist(), np.column_stack([e @ val, e.sum(axis=1)]).tolist())

    keys = k.join(v.select("b", "h", "p", F.col("x").alias("y")), ["b", "h", "p"])
    parts = _over_pairs(_tile_pairs(q, keys, tile, causal), partial, ["p", "m", "o"], "p bigint, m double, o array<double>")
    whole = Window.partitionBy("b", "h", "p")  # a row a tile of keys
    scaled = parts.withColumn("top", F.max("m").over(whole)).withColumn("f", F.exp(F.col("m") - F.col("top")))
    sums = scaled.select("b", "h", "p", "top", "f", F.posexplode("o").alias("k", "o")).groupBy("b", "h", "p", "k").agg(F.sum(F.col("o") * F.col("f")).alias("o"), F.first("top").alias("top"))
    rows = sums.groupBy("b", "h", "p").agg(F.sort_array(F.collect_list(F.struct("k", "o"))).alias("os"), F.first("top").alias("top"))
    norm = F.element_at("os", -1)["o"]  # the last column is the sum of weights
    return rows.select("b", "h", "p", F.transform(F.slice("os", F.lit(1), F.size("os") - 1), lambda c: c["o"] / norm).alias("o"), (F.col("top") + F.log(norm)).alias("lse"))


def backward_tiled(q: DataFrame, k: DataFrame, v: DataFrame, grad: DataFrame, tile: int, causal: bool = False) -> DataFrame:
    """which (dq, dk, dv), b, h, p, k, v: as backward, but probabilities come again from the forward pass's log-sum-exp, one pair of tiles at a time.

    The partial gradients of pairs are summed by position; no row of scores or probabilities is kept or shuffled.
    """

    def partial(qs: list, ks: list) -> Iterator[tuple]:
        (qp, x, g, lse, delta), (kp, y, val) = _matrices(qs, "p", "x", "g", "lse", "delta"), _matrices(ks, "p", "x", "y")
        p = np.exp(_scores(x, y, qp, kp, causal) - lse[:, None])
        ds = p * (g @ val.T - delta[:, None]) / np.sqrt(x.shape[1])
        for which, at, m in (("dq", qp, ds @ y), ("dk", kp, ds.T @ x), ("dv", kp, p.T @ g)):
            for i, row in zip(at.astype(np.int64).tolist(), m.tolist()):
                yield which, i, row

    passed = grad.select("b", "h", "p", F.col("x").alias("g")).join(_forward(q, k, v, tile, causal), ["b", "h", "p"])
    delta = F.aggregate(F.zip_with("g", "o", lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c)
    queries = q.join(passed.select("b", "h", "p", "g", "lse", delta.alias("delta")), ["b", "h", "p"])
    keys = k.join(v.select("b", "h", "p", F.col("x").alias("y")), ["b", "h", "p"])
    parts = _over_pairs(_tile_pairs(queries, keys, tile, causal), partial, ["which", "p", "x"], "which string, p bigint, x array<double>")
    return parts.select("which", "b", "h", "p", F.posexplode("x").alias("k", "v")).groupBy("which", "b", "h", "p", "k").agg(F.sum("v").alias("v"))


def backward(q: DataFrame, k: DataFrame, v: DataFrame, grad: DataFrame, causal: bool = False) -> DataFrame:
    """which (dq, dk, dv), b, h, p, k, v: gradients for output gradient grad, from P and row sums of dO * O.

    Pairs of positions meet once, as array rows dealt by sequence and head; row sums of dO * O are sums of P * dP over a row, so no table
    of features or scores is joined again. Softmax and all sums stay where the pairs are.
    """
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    mine = q.select("b", "h", "p", "x").join(grad.select("b", "h", "p", F.col("x").alias("g")), ["b", "h", "p"])
    theirs = k.select("b", "h", F.col("p").alias("s"), F.col("x").alias("y")).join(v.select("b", "h", F.col("p").alias("s"), F.col("x").alias("val")), ["b", "h", "s"])
    pairs = mine.join(theirs, ["b", "h"])
    root, w = F.sqrt(F.size("x").cast("double")), Window.partitionBy("b", "h", "p")
    scored = (pairs.where("s <= p") if causal else pairs).withColumn("score", dot("x", "y") / root).withColumn("dp", dot("g", "val")).drop("val")
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    soft = e.withColumn("w", F.col("e") / F.sum("e").over(w))
    ds = soft.withColumn("ds", F.col("w") * (F.col("dp") - F.sum(F.col("w") * F.col("dp")).over(w)) / root)
    part = lambda which, at, by, x: F.struct(F.lit(which).alias("which"), F.col(at).alias("p"), F.transform(x, lambda c: c * F.col(by)).alias("x"))
    parts = ds.select("b", "h", F.inline(F.array(part("dq", "p", "ds", "y"), part("dk", "s", "ds", "x"), part("dv", "s", "w", "g"))))
    return parts.select("which", "b", "h", "p", F.posexplode("x").alias("k", "v")).groupBy("which", "b", "h", "p", "k").agg(F.sum("v").alias("v"))
