"""Sharding by fixed virtual slots (operator 9), in DataFrame functions only.

A record hashes by doc_id into one of ``slots`` fixed virtual slots. Bytes and rows are summed per
slot (partial sums before the shuffle, so a slot's size does not matter), and a map from slot to
shard is stored as a versioned table: version 1 deals the slots out, largest first, each to the
shard with the least bytes so far; ``rebalance`` edits the latest version by moving only as many
slots as even out new sizes. The map has ``slots`` rows whatever the input, which bounds what is
broadcast and what the one-row arithmetic on it holds.

Law: ``bytes`` (shards are near equal in bytes; ``grown_shard`` is null).
Position in a shard: rows of the shard's earlier slots plus the rank inside the slot, so the rank is
taken in thousands of independent groups and never over a whole shard.

A map that is stored under the given path is used as it is: a run deals slots out only where there is none yet.

Edge cases: null text has 0 bytes (size 8), and the crc32 of the empty string; rows of null doc_id have nothing to
hash and are spread over the slots by their place in the input; repeated rows get positions of their own, in no stated order among equal ones. An
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, scratch_path, session, written

SLOTS, SHARDS, LAW = 8192, 24, "bytes"


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.monotonically_increasing_id(), F.lit(slots))), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sums: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, shard: each slot, largest first, to the shard with the least bytes so far.

    One row of at most ``slots`` entries does the arithmetic; fullness is kept as one number per
    shard, bytes * shards + shard, so that the least one also breaks ties.
    """
    start = ", ".join(f"{s}L" for s in range(shards))
    entry = "struct(-bytes AS neg, virtual_slot AS s)"
    fold = (
        f"aggregate(sort_array(all), named_struct('full', array({start}), 'out', cast(array() as array<struct<virtual_slot:int, shard:int>>)), "
        f"(a, x) -> named_struct('full', transform(a.full, f -> if(f = array_min(a.full), f - x.neg * {shards}, f)), "
        f"'out', array_append(a.out, named_struct('virtual_slot', x.s, 'shard', cast(array_min(a.full) % {shards} as int)))), a -> a.out)"
    )
    every = session(sums).range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    return sums.agg(F.collect_list(F.expr(entry)).alias("all")).select(F.expr(f"explode({fold}) AS m")).select("m.virtual_slot", "m.shard")


def store_map(new: DataFrame, path: str, version: int) -> None:
    """Adds a version to the stored map; earlier ones stay."""
    new.select(F.lit(version).alias("map_version"), "virtual_slot", "shard").coalesce(1).write.mode("append").parquet(path)


def latest_map(spark: SparkSession, path: str) -> DataFrame:
    kept = spark.read.schema("map_version int, virtual_slot int, shard int").parquet(path)
    version = kept.agg(F.max("map_version").alias("v")).head()["v"]
    return kept.where(F.col("map_version") == F.lit(version))


def rebalance(spark: SparkSession, path: str, sums: DataFrame, shards: int, slack: float = 0.01) -> DataFrame:
    """Edits the latest map for new sums and stores it as the next version.

    Slots stay where they are while their shard holds at most (1 + slack) times the mean; the
    largest slots of a fuller shard, and those of shards that no longer exist, are dealt anew to the
    emptiest shards. The work is on the map's rows only, whose number is fixed.
    """
    old = latest_map(spark, path)
    version = old.agg(F.max("map_version").alias("v")).head()["v"] or 0
    sized_map = old.select("virtual_slot", F.col("shard").alias("was")).join(F.broadcast(sums), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("bigint"))
    w = Window.partitionBy("was").orderBy("bytes", "virtual_slot")
    mean = sums.agg((F.sum("bytes") / shards).alias("mean"))
    held = sized_map.crossJoin(F.broadcast(mean)).withColumn("upto", F.sum("bytes").over(w))
    stays = F.col("was").isNotNull() & (F.col("was") < shards) & (F.col("upto") <= F.col("mean") * (1 + slack))
    held = held.select("virtual_slot", "bytes", F.when(stays, F.col("was")).alias("was"))
    start = ", ".join(f"{s}L" for s in range(shards))
    fold = (
        f"aggregate(sort_array(transform(filter(all, x -> x.was IS NULL), x -> struct(-x.bytes AS neg, x.virtual_slot AS s))), "
        f"named_struct('full', transform(array({start}), f -> f + {shards} * aggregate(filter(all, x -> x.was = f), 0L, (b, x) -> b + x.bytes)), "
        f"'out', transform(filter(all, x -> x.was IS NOT NULL), x -> named_struct('virtual_slot', x.virtual_slot, 'shard', x.was))), "
        f"(a, x) -> named_struct('full', transform(a.full, f -> if(f = array_min(a.full), f - x.neg * {shards}, f)), "
        f"'out', array_append(a.out, named_struct('virtual_slot', x.s, 'shard', cast(array_min(a.full) % {shards} as int)))), a -> a.out)"
    )
    new = held.agg(F.collect_list(F.struct("virtual_slot", "bytes", "was")).alias("all")).select(F.expr(f"explode({fold}) AS m")).select("m.virtual_slot", "m.shard")
    store_map(new, path, version + 1)
    return latest_map(spark, path)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored under path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and bool(spark.read.schema("map_version int").parquet(path).head(1))


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Each row's shard and position, by the latest map under map_path (default: a new scratch folder); without one, version 1 is dealt and stored there."""
    spark = session(docs)
    path = map_path or scratch_path(spark, "slot-map")
    rows = written(sized(docs, slots), "shard-rows")  # the texts are read once, and rows keep their slots
    if not map_path or not stored(spark, path):
        store_map(first_map(slot_sums(rows), shards, slots), path, 1)
    placed = latest_map(spark, path)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)  # over the map's rows
    offsets = slot_sums(rows).join(F.broadcast(placed), "virtual_slot").select("map_version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(f"{OWN}start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn(f"{OWN}rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col(f"{OWN}start") + F.col(f"{OWN}rank")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "map_version",
        )
    )
