"""Next-token training windows over arrays of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(rows: DataFrame, context: int, step: int = 1, key: str = "doc_id", last: bool = False) -> DataFrame:
    """key, start, x, y for starts 0, step, ... below len - context; y is x shifted by one. Shorter arrays have no window.

    last: the last start that fits is one too, so every id is in a window.
    """
    longer = rows.where(F.size("ids") > context)
    starts = F.sequence(F.lit(0), F.size("ids") - context - 1, F.lit(step))
    if last:
        starts = F.array_union(starts, F.array(F.size("ids") - context - 1))
    return _cut(longer.withColumn("start", F.explode(starts)), [key, "start"], context)


def batch(rows: DataFrame, context: int, size: int, key: str = "doc_id") -> DataFrame:
    """key, sample, start, x, y: size windows of each array, with starts from a linear congruential generator."""
    longer = rows.where(F.size("ids") > context).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    start = (F.col("sample").cast("bigint") * 1103515245 + 12345) % (F.size("ids") - context)
    return _cut(longer.withColumn("start", start), [key, "sample", "start"], context)


def _cut(rows: DataFrame, keep: list[str], context: int) -> DataFrame:
    at = F.col("start").cast("int")
    return rows.select(*keep, F.slice("ids", at + 1, F.lit(context)).alias("x"), F.slice("ids", at + 2, F.lit(context)).alias("y"))
