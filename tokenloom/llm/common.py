"""What the training-data operators share: scratch tables, contiguous doc_id ranges, safe columns."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of columns that operators add for their own use start so; inputs may hold any other name.
OWN = "_tl_"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark, path = session(df), scratch_path(session(df), name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    paths = {f.rpartition("/")[0] for f in df.inputFiles()}
    for p in paths:
        if urlparse(p).path.startswith(urlparse(scratch_root(spark)).path):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean() -> None:
    """Called where a Python task begins: workers live on from step to step, so memory of earlier steps goes back first."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


#: Keys that hold more than this part of all rows are looked up by broadcast: there are fewer of them than this number.
HOT_KEYS = 4096


def looked_up(rows: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of one (a row for each key) joined on key; one's column count, dropped here, says how many of the total rows hold it.

    Rows of hot keys stay in place: at most HOT_KEYS keys hold more than total / HOT_KEYS rows each, so their side is broadcast.
    The others are joined by a shuffle in which no key fills more than that share. Null keys match nothing.
    """
    hot = F.col(count) * HOT_KEYS > total
    few, rest = one.where(hot).drop(count), one.where(~hot).drop(count)
    cold = rows.where(F.col(key).isNotNull()).join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(cold.join(rest, key))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished steps now, not when the driver next collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most a thousand or 8 MB: texts are long, and each batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def fan_out(spark: SparkSession) -> int:
    """As many ranges as a shuffle has partitions: this follows the size of the cluster and of the job."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_bounds(df: DataFrame, key: str, parts: int, repeats: bool = False) -> list[int]:
    """Ascending inner bounds that cut key into about equal ranges; at most parts - 1 numbers reach the driver.

    repeats: a key that fills several ranges is a bound as often.
    """
    if parts < 2:
        return []
    row = df.agg(F.percentile_approx(F.col(key), [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("b")).head()
    return sorted((row["b"] or []) if repeats else set(row["b"] or []))


def longs(values: list[int | None]) -> Column:
    """An array<bigint> that stays one literal in the plan, however long."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def range_of(key: Column, bounds: list[int], below: bool = False) -> Column:
    """How many bounds are at or below key (below: only below; null: -1), by binary search inside the JVM."""
    if not bounds:  # one range
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    steps, w = [], 1
    while w <= len(bounds):
        steps.insert(0, w)
        w *= 2
    table = longs(bounds)
    passed = lambda x: x < key if below else x <= key
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, s: F.when((acc + s <= len(bounds)) & passed(F.get(table, acc + s - 1)), acc + s).otherwise(acc),
    )
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)
