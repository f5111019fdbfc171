"""Optimizer operators over parameter tables (name, i, j, v): schedule, clipping, keyed AdamW, sharded forms."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["name", "i", "j"]


def cosine_lr(step: Column, top: float, bottom: float, warmup: int, cycle: int) -> Column:
    """Linear warm-up below warmup, half a cosine up to cycle, bottom afterwards."""
    share = (step - warmup) / F.lit(float(max(1, cycle - warmup)))
    cosine = F.lit(bottom) + (F.lit(1.0) + F.cos(share * F.lit(math.pi))) * F.lit((top - bottom) / 2)
    return F.when(step < warmup, step / F.lit(float(max(1, warmup))) * F.lit(top)).when(step <= cycle, cosine).otherwise(F.lit(bottom))


def global_norm(grads: DataFrame) -> DataFrame:
    """One row: the norm over all gradients; 0 if there are none."""
    return grads.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("norm"))


def clip(grads: DataFrame, most: float, always: bool = False) -> DataFrame:
    """Gradients scaled to a norm of at most most. always: the variant that multiplies by min(1, most / (norm + 1e-6)) whatever the norm."""
    factor = F.lit(most) / (F.col("norm") + F.lit(1e-6))
    factor = F.least(F.lit(1.0), factor) if always else F.when(F.col("norm") <= most, F.lit(1.0)).otherwise(factor)
    scaled = grads.crossJoin(F.broadcast(global_norm(grads)))  # one row
    return scaled.select(*KEYS, (F.col("v") * factor).alias("v"))


def check_adamw(lr: float, betas: tuple[float, float], eps: float, decay: float) -> None:
    if lr < 0 or eps < 0 or decay < 0:
        raise ValueError("lr, eps and weight decay must not be negative")
    if not all(0 <= b < 1 for b in betas):
        raise ValueError("betas must lie in [0, 1)")


def adamw(state: DataFrame, grads: DataFrame, step: int, lr: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, decay: float = 0.01, eps_first: bool = False) -> DataFrame:
    """The next state (name, i, j, v, m, s) from the last one and gradients; step counts from 1.

    Parameters without a gradient stay as they are; state that is missing starts at 0. eps_first: the
    variant that adds eps to the root before the bias correction.
    The update of a row needs that row only, so any partitioning by KEYS shards parameters, gradients and state.
    """
    check_adamw(lr, betas, eps, decay)
    b1, b2 = betas
    g = grads.select(*KEYS, F.col("v").alias("g"))
    old_m, old_s = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("m", "s"))
    rows = state.join(g, KEYS, "left")
    m = old_m * b1 + F.col("g") * (1 - b1)
    s = old_s * b2 + F.col("g") * F.col("g") * (1 - b2)
    fix1, fix2 = 1 - b1**step, 1 - b2**step
    move = F.lit(lr * math.sqrt(fix2) / fix1) * m / (F.sqrt(s) + eps) if eps_first else F.lit(lr / fix1) * m / (F.sqrt(s / F.lit(fix2)) + eps)
    has = F.col("g").isNotNull()
    return rows.select(*KEYS, F.when(has, F.col("v") * F.lit(1 - lr * decay) - move).otherwise(F.col("v")).alias("v"), F.when(has, m).otherwise(old_m).alias("m"), F.when(has, s).otherwise(old_s).alias("s"))


def fresh(params: DataFrame) -> DataFrame:
    return params.select(*KEYS, "v", F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))


def averaged(grads: DataFrame) -> DataFrame:
    """Gradients of all ranks (rank, name, i, j, v) averaged: partial sums on each side of the shuffle."""
    return grads.groupBy(*KEYS).agg(F.avg("v").alias("v"))


def sharded(params: DataFrame, shards: int) -> DataFrame:
    """Parameters with the shard that holds them: matrices by blocks of rows, one-row parameters on every shard."""
    whole = params.groupBy("name").agg((F.max("i") + 1).alias("rows"))
    out = params.join(F.broadcast(whole), "name")  # one row a parameter name
    own = F.floor(F.col("i") * shards / F.col("rows")).cast("int")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    return out.withColumn("shard", F.explode(F.when(F.col("rows") > 1, F.array(own)).otherwise(every))).drop("rows")


def gathered(shards: DataFrame) -> DataFrame:
    """Full parameters from shards; replicas must agree."""
    same = F.max("v") == F.min("v")
    v = F.when(same, F.max("v")).otherwise(F.raise_error(F.lit("replicas differ")).cast("double"))
    return shards.groupBy(*KEYS).agg(v.alias("v"))


def reduce_scattered(grads: DataFrame, shards: int) -> DataFrame:
    """Averaged gradients, each row on the shard of its parameter."""
    return sharded(averaged(grads), shards)


def compute_copy(shards: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """Full parameters (name, i, j, v) in a compute type, gathered from shards of the master ones, which stay as they are."""
    return gathered(shards).withColumn("v", of(F.col("v")))


def linear_gradient(rows: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """rank, name, i, j, v: each rank's mean gradient of (x W^T - y)^2 / 2 over its rows (rank, x, y); y has an entry a row of W."""
    spread = rows.select("rank", F.monotonically_increasing_id().alias("row"), "x", "y")
    w = weights.where(F.col("name") == name).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("w"))
    matrix = w.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda r: r["w"]).alias("m"))  # one row: the layer that is computed
    off = lambda m: F.transform(m, lambda r, i: F.aggregate(F.zip_with(r, "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - F.get("y", i))
    each = spread.crossJoin(F.broadcast(matrix)).select("rank", "x", F.posexplode(off(F.col("m"))).alias("i", "e")).select("rank", "i", "e", F.posexplode("x").alias("j", "x"))
    return each.groupBy("rank", "i", "j").agg(F.avg(F.col("e") * F.col("x")).alias("v")).select("rank", F.lit(name).alias("name"), "i", "j", "v")


def sharded_step(shards: DataFrame, rows: DataFrame, name: str, many: int, step: int, of: Callable[[Column], Column], **options) -> DataFrame:
    """The next shards (shard, name, i, j, v, m, s) of a linear layer after one step on the ranks' rows (rank, x, y).

    Weights are gathered and rounded by of, used with rounded inputs, and let go; the mean gradient goes back to the shards, rounded too.
    The master parameters are kept in single precision and each shard updates its own.
    """
    copied = rows.select("rank", *[F.transform(c, of).alias(c) for c in ("x", "y")])
    grads = linear_gradient(copied, compute_copy(shards.select("shard", *KEYS, "v"), of), name)
    back = reduce_scattered(grads, many).withColumn("v", of(F.col("v")))
    state = shards.withColumn("name", F.concat_ws("@", "name", F.col("shard").cast("string")))
    own = back.withColumn("name", F.concat_ws("@", "name", F.col("shard").cast("string")))
    single = lambda c: F.col(c).cast("float").cast("double").alias(c)
    new = adamw(state, own.select(*KEYS, "v"), step, **options)
    part = F.split("name", "@")
    return new.select(part[1].cast("int").alias("shard"), part[0].alias("name"), "i", "j", *[single(c) for c in ("v", "m", "s")])


def differing_replicas(replicas: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Rows of (rank, name, i, j, v) whose values on some ranks lie further apart than tolerance."""
    return replicas.groupBy(*KEYS).agg((F.max("v") - F.min("v")).alias("spread")).where(F.col("spread") > tolerance)
