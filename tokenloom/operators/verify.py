"""Verification operators: comparing keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def different_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one table only, with the side that has them."""
    only = lambda x, y, s: x.select(*keys).join(y.select(*keys), keys, "left_anti").select(*keys, F.lit(s).alias("side"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def not_close(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-4, atol: float = 1e-6) -> DataFrame:
    """Rows, keyed by keys, that one table lacks or whose v differs by more than atol + rtol * |b|."""
    x, y = a.select(*keys, F.col("v").alias("left_v")), b.select(*keys, F.col("v").alias("right_v"))
    far = F.abs(F.col("left_v") - F.col("right_v")) > F.lit(atol) + F.lit(rtol) * F.abs("right_v")
    return x.join(y, keys, "full_outer").where(F.col("left_v").isNull() | F.col("right_v").isNull() | far)


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other has fewer times, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def outside_deviations(counts: DataFrame, draws: int, cells: int, deviations: float = 5.0) -> DataFrame:
    """Cells (start, n) whose count lies further from uniform than so many deviations."""
    p = 1.0 / cells
    mean, dev = draws * p, (draws * p * (1 - p)) ** 0.5
    return counts.where(F.abs(F.col("n") - mean) > deviations * dev)
