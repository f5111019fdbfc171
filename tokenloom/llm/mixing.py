"""Mixing sources to target weights by Poisson replication (operator 5).

A source whose target share of the bytes is w and whose own share is s repeats each of its documents
w / s times on average. How often one document stands in the mixture is Poisson distributed with that
mean: a hash of (seed, doc_id) gives a uniform number, and inverting the distribution at it gives the
count, so any subset of the data, any partitioning and any rerun draw the same copies. Documents
are exploded by their counts and shuffled globally, in the order of a hash of (seed, doc_id, copy): it is uniform, so
equal ranges of it are partitions of equal size, without a sampling pass that would draw everything twice.

A rate over ``STEP`` is drawn as the sum of equal parts, each inverted from a hash of its own, so
the probabilities never underflow. Sums per source are partial before their shuffle, and the table of
rates has one row for each source; it is broadcast up to ``BROADCAST_ROWS`` rows and joined by a
shuffle beyond.

Default targets: the shares of the sources' bytes to the power ``ALPHA``, which raises small sources
and lowers large ones.

Edge cases: null source is a source of its own; null or empty text has no bytes and is drawn at its
source's rate, which is 1.0 if the whole source is empty; a row of null doc_id is drawn by its text in place of the id, and such rows
of one text by their number among these (in the order of source) too, so each has a draw of its own;
repeated rows of one doc_id share a draw, and each is repeated so often. Sources without a target (when targets are given) have
rate 0. An empty table gives no rows. Columns of the documents stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, fan_out, session, written

ALPHA, SEED, STEP, BROADCAST_ROWS = 0.7, "mix-1", 32.0, 100_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash that other engines compute alike: 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, bytes, weight (target share) and rate (mean copies of a document)."""
    sums = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).alias("bytes"))
    if targets is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for source, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    sums = sums.withColumn("weight", F.when(F.col("bytes") > 0, weight).otherwise(0.0))
    total = sums.agg(F.sum("bytes").alias("b"), F.sum("weight").alias("w")).head()
    whole, weights = float(total["b"] or 0), float(total["w"] or 0)
    rate = F.col("weight") / F.lit(weights or 1.0) * F.lit(whole) / F.col("bytes")
    return sums.select("source", "bytes", (F.col("weight") / F.lit(weights or 1.0)).alias("weight"), F.when(F.col("bytes") > 0, rate).otherwise(1.0).alias("rate"))


def _inverse(u: Column, rate: Column) -> Column:
    """The smallest n at which the Poisson distribution function of the rate exceeds u; sums up to 12 deviations and 40 beyond the mean."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("upto"), F.lit(0).alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["upto"] + p).alias("upto"), F.when(a["upto"] <= u, k).otherwise(a["n"]).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["n"])


def named(docs: DataFrame) -> DataFrame:
    """docs with what the hashes know a document by: its doc_id, or else its text and number among the rows of this text without an id.

    Numbers are a number inside the task that reads a row, and an offset from the counts of each (text, source, task), so
    many rows of one text meet in no task. Rows without an id are written first: a retried task reads the same ones.
    """
    name, text, task, at, before = (f"{OWN}{x}" for x in ("name", "text", "task", "at", "before"))
    known = docs.withColumn(name, F.col("doc_id").cast("string"))
    if not docs.where("doc_id IS NULL").head(1):
        return known
    none = written(docs.where("doc_id IS NULL"), "mixing-nameless").withColumn(text, F.md5(F.coalesce("text", F.lit("")))).withColumn(task, F.spark_partition_id())
    none = none.withColumn(f"{OWN}row", F.monotonically_increasing_id())
    counts = none.groupBy(text, "source", task).count()
    by = Window.partitionBy(text).orderBy(F.col("source").asc_nulls_first(), task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(text).alias(f"{text}2"), F.col("source").alias(f"{OWN}source2"), F.col(task).alias(f"{task}2"), F.coalesce(F.sum("count").over(by), F.lit(0)).alias(before))
    inside = none.withColumn(at, F.row_number().over(Window.partitionBy(text, "source", task).orderBy(f"{OWN}row")) - 1)
    same = (inside[text] == offsets[f"{text}2"]) & inside["source"].eqNullSafe(offsets[f"{OWN}source2"]) & (inside[task] == offsets[f"{task}2"])
    number = F.col(at) + F.col(before)
    own = F.concat(F.lit("text:"), F.col(text), F.when(number > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise(""))
    numbered = inside.join(offsets, same).withColumn(name, own).select(*[F.col(f"`{c}`") for c in docs.columns], name)
    return known.where("doc_id IS NOT NULL").unionByName(numbered)


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """How often a document stands in the mixture."""
    parts = F.greatest(F.ceil(rate / F.lit(STEP)), F.lit(1)).cast("int")
    draw = lambda i: _inverse(uniform(seed, doc_id, i), rate / parts)
    many = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda a, i: a + draw(i))
    return F.when(rate > 0, many).otherwise(0)


def mixed(docs: DataFrame, targets: dict[str | None, float] | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """docs exploded by their counts, with copy (from 0), rate and shuffle_key, in the order of shuffle_key."""
    table = written(rates(docs, targets, alpha), "mixing-rates")
    table = table.select(F.col("source").alias(f"{OWN}source"), F.col("rate").alias(f"{OWN}rate"))
    rows = table.count()
    docs = named(docs)
    joined = docs.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, docs["source"].eqNullSafe(table[f"{OWN}source"]))
    drawn = joined.withColumn(f"{OWN}n", copies(F.col(f"{OWN}name"), F.col(f"{OWN}rate"), seed)).where(F.col(f"{OWN}n") > 0)
    each = drawn.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(0), F.col(f"{OWN}n") - 1)))
    each = each.withColumn(f"{OWN}key", uniform(f"{seed}-order", F.col(f"{OWN}name"), F.col(f"{OWN}copy")))
    parts = fan_out(session(docs))
    dealt = each.repartitionById(parts, F.floor(F.col(f"{OWN}key") * parts).cast("int")).sortWithinPartitions(f"{OWN}key")
    return dealt.drop(f"{OWN}source", f"{OWN}n", f"{OWN}name")


def mixture(docs: DataFrame, targets: dict[str | None, float] | None = None) -> DataFrame:
    """doc_id, source, copy, rate, shuffle_key of every row of the mixture, globally shuffled."""
    out = mixed(docs.select("doc_id", "source", "text"), targets)
    return out.select("doc_id", "source", F.octet_length("text").alias("bytes"), F.col(f"{OWN}copy").alias("copy"), F.round(f"{OWN}rate", 9).alias("rate"), F.col(f"{OWN}key").alias("shuffle_key"))


def replicated(docs: DataFrame, targets: dict[str | None, float] | None = None) -> DataFrame:
    """docs with each row repeated by its count, globally shuffled; their columns stay as they are."""
    return mixed(docs, targets).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(alpha: float = ALPHA, seed: str = SEED, step: float = STEP) -> str:
    """mixture() of documents in DuckDB, with the probabilities summed as lists."""
    return f"""
WITH sums AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY source),
weights AS (SELECT source, bytes, CASE WHEN bytes > 0 THEN pow(CAST(bytes AS DOUBLE), {alpha}) ELSE 0 END AS w FROM sums),
rates AS (SELECT source, CASE WHEN bytes > 0 THEN w / sum(w) OVER () * CAST(sum(bytes) OVER () AS DOUBLE) / bytes ELSE 1.0 END AS rate FROM weights),
parts AS (SELECT source, rate, CAST(greatest(ceil(rate / {step}), 1) AS INT) AS parts FROM rates),
steps AS (SELECT source, rate, parts, unnest(range(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts) + 40) AS BIGINT))) AS k FROM parts),
terms AS (SELECT source, rate, parts, k, exp(-rate / parts) * pow(rate / parts, k) / exp(lgamma(k + 1)) AS p FROM steps),
upto AS (SELECT source, rate, parts, list(s ORDER BY k) AS cdf FROM (SELECT *, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM terms) GROUP BY source, rate, parts),
numbered AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id IS NULL, coalesce(text, '') ORDER BY source NULLS FIRST) - 1 AS number FROM documents),
named AS (SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')) || CASE WHEN number > 0 THEN ':' || number ELSE '' END) AS name FROM numbered),
draws AS (SELECT d.doc_id, d.name, d.source, strlen(d.text) AS bytes, u.rate, u.cdf, unnest(range(0, u.parts)) AS i FROM named d JOIN upto u ON d.source IS NOT DISTINCT FROM u.source WHERE u.rate > 0),
counts AS (SELECT doc_id, name, source, bytes, rate, CAST(sum(len(list_filter(cdf, lambda c: c <= CAST(('0x' || substr(md5(concat_ws('|', '{seed}', name, CAST(i AS VARCHAR))), 1, 13)) AS BIGINT) / CAST({1 << 52} AS DOUBLE)))) AS INT) AS n FROM draws GROUP BY doc_id, name, source, bytes, rate),
each AS (SELECT doc_id, name, source, bytes, rate, CAST(unnest(range(0, n)) AS INT) AS copy FROM counts WHERE n > 0)
SELECT doc_id, source, CAST(bytes AS INT) AS bytes, copy, round(rate, 9) AS rate,
  CAST(('0x' || substr(md5(concat_ws('|', '{seed}-order', name, CAST(copy AS VARCHAR))), 1, 13)) AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS shuffle_key
FROM each"""
