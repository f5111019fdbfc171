"""Connected components of links by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, session, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root of every node of links (columns a, b: long; self links are dropped): root is the least node of its component.

    Each round regroups links on nodes and writes them to the shared folder, so the lineage stays short and no
    node, link or component reaches the driver; it ends when the links are stars around their least
    nodes, after about the logarithm of the longest path. Null ends are dropped.
    """
    spark = session(links)
    own = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _kept(own)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after, new_mark = _kept(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        forget(spark, now)
        now = after
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("the links did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The written links and a mark that changes with them."""
    kept = written(links, "links")
    return kept, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
