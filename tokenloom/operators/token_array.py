"""One token array over all documents: global offsets, blocks, and windows that run on from document to document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BLOCK = 4096


def _tied(rows: DataFrame, key: str) -> DataFrame:
    """key, ids, tie, n: null ids are empty; rows of equal key, tie and n are copies."""
    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return rows.select(key, ids).withColumn("tie", F.xxhash64("ids")).withColumn("n", F.size("ids"))


def places(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tie, n, copies, start: where the ids of each row lie, without the ids; the copies of a row lie one behind the other.

    The array's order is that of key (nulls first), ties by a hash of the ids. Only keys and lengths are sorted: they are dealt to ranges
    and written, so a retried task sees the same ranges; sums of the ranges are one row each, and running sums stay inside a range.
    """
    order = [F.col(key).asc_nulls_first(), F.col("tie").asc(), F.col("n").asc()]
    lengths = _tied(rows, key).groupBy(key, "tie", "n").agg(F.count("*").alias("copies"))
    dealt = written(lengths.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "token-ranges")
    size = F.col("n") * F.col("copies")
    sums = dealt.groupBy("part").agg(F.sum(size).alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    bases = sums.select("part", before.alias("base"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inside", inside).join(F.broadcast(bases), "part").select(key, "tie", "n", "copies", (F.col("base") + F.col("inside")).alias("start"))


def copies_of(placed: DataFrame) -> DataFrame:
    """places() with a row and a start for each copy."""
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return each.withColumn("start", F.col("start") + F.col("copy") * F.col("n")).drop("copies")


def _met(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of _tied() beside found (key, tie, n, ...): texts are shuffled once and not sorted, as found is the side that is looked up."""
    f = found.select(F.col(key).alias("key_"), F.col("tie").alias("tie_"), F.col("n").alias("n_"), *[c for c in found.columns if c not in (key, "tie", "n")])
    same = F.col(key).eqNullSafe(F.col("key_")) & (F.col("tie") == F.col("tie_")) & (F.col("n") == F.col("n_"))
    return rows.join(f.hint("shuffle_hash"), same).drop("key_", "tie_", "n_")


def offsets(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ids, start: start is the number of ids before this row in ascending key order (nulls first, ties by the ids). Null ids are empty."""
    met = _met(_tied(rows, key), places(rows, key), key)
    nth = F.row_number().over(Window.partitionBy(key, "tie", "n").orderBy("start")) - 1
    more = met.where("copies > 1").withColumn("start", F.col("start") + nth * F.col("n"))
    return met.where("copies = 1").unionByName(more).select(key, "ids", "start")


def blocks(placed: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, ids: the array of offsets() in blocks of size ids (the last may be shorter). No row holds more than a document or a block."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("ids") - 1) / size)
    cut = placed.where(F.size("ids") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block") * size, F.col("start"))
    high = F.least((F.col("block") + 1) * size, F.col("start") + F.size("ids"))
    piece = F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    pieces = F.sort_array(F.collect_list(F.struct(low.alias("at"), piece.alias("ids"))))  # size ids at most, in pieces of one or more
    return cut.groupBy("block").agg(F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"))


def starts(total: int, context: int, many: int, spark, seed: str = "batch") -> DataFrame:
    """sample, start: many starts, uniform in [0, total - context) with replacement, from a hash of seed and sample."""
    if total <= context:
        raise ValueError(f"an array of {total} ids has no window of {context} and a next id")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("sample").cast("string"))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    return spark.range(many).withColumnRenamed("id", "sample").withColumn("start", F.floor(u * F.lit(float(total - context))))


def _wanted_of(placed: DataFrame, wanted: DataFrame, context: int, key: str, size: int) -> DataFrame:
    """key, tie, n, copies, pieces: the pieces (sample, start, at, low, len) of wanted windows that lie in a row of placed, a list for each copy.

    low is the place in the row, at that in the window. Windows meet rows by the blocks of size ids that both lie in, and count in the first of these.
    """
    spans = copies_of(placed.where("n > 0").withColumn("of", F.col("copies"))).withColumnRenamed("start", "first")
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("n") - 1) / size))))
    end = F.col("start") + context + 1  # behind y's last id
    asked = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))))
    low, high = F.greatest("start", "first"), F.least(end, F.col("first") + F.col("n"))
    met = spans.join(asked, "block").where((low < high) & (F.col("block") == F.floor(low / size)))
    piece = F.struct("sample", "start", (low - F.col("start")).cast("int").alias("at"), (low - F.col("first")).cast("int").alias("low"), (high - low).cast("int").alias("len"))
    return met.groupBy(key, "tie", "n", "of", "copy").agg(F.collect_list(piece).alias("pieces")).drop("copy").withColumnRenamed("of", "copies")


def _cut(rows: DataFrame, pieces: DataFrame, context: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Windows inside one row (sample, start, x, y), and the pieces of others (sample, start, at, ids); rows hold a key, tie and n once."""

    def of(keep: Callable[[Column], Column]) -> DataFrame:
        kept = pieces.withColumn("pieces", F.filter("pieces", keep)).where("size(pieces) > 0")
        return _met(rows, kept, key).select("ids", F.inline("pieces"))

    part = lambda by, n: F.slice("ids", F.col("low") + by, n)
    whole = of(lambda p: p["len"] > context).select("sample", "start", part(1, F.lit(context)).alias("x"), part(2, F.lit(context)).alias("y"))
    return whole, of(lambda p: p["len"] <= context).select("sample", "start", "at", part(1, F.col("len")).alias("ids"))


def sampled(rows: DataFrame, context: int, many: int | None = None, key: str = "doc_id", seed: str = "batch", size: int = BLOCK) -> DataFrame:
    """sample, start, x, y of many windows (by default total // context, an epoch's worth) of the one array of all rows' ids: x is context ids from start on, y the same one id on.

    Windows are found from keys and lengths alone and go to the rows, which are shuffled once. A window inside a row is cut out there; of
    windows over several rows, the pieces meet again.
    """
    placed = written(places(rows, key), "token-places")
    total, most = placed.agg(F.sum(F.col("n") * F.col("copies")), F.max(F.when(F.col("n") > 0, F.col("copies")))).head()
    wanted = starts(total or 0, context, (total or 0) // context if many is None else many, rows.sparkSession, seed)
    pieces = written(_wanted_of(placed, wanted, context, key, size), "token-pieces")
    tied = _tied(rows, key).where("n > 0")
    whole, parts = _cut(tied, pieces.where("copies = 1"), context, key)
    if (most or 1) > 1:
        once = _met(tied, placed.where("copies > 1").select(key, "tie", "n"), key).dropDuplicates([key, "tie", "n"])
        more = _cut(once, pieces.where("copies > 1"), context, key)
        whole, parts = whole.unionByName(more[0]), parts.unionByName(more[1])
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"]))
    met = parts.groupBy("sample", "start").agg(ids.alias("w"))
    return whole.unionByName(met.select("sample", "start", F.slice("w", 1, context).alias("x"), F.slice("w", 2, context).alias("y")))
