"""Vocabulary, merge and configuration files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def byte_letters() -> dict[int, str]:
    """The public byte-to-letter table: printable bytes stand for themselves, the others for code points from 256 in their order."""
    # The printable byte ranges of the public table.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)}


def save(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """path/vocab: JSON lines of token_id and token (hex); path/merges: tab-separated rank, l, r."""
    vocab.select("token_id", "token").coalesce(1).write.json(f"{path}/vocab")
    merges.select("rank", "l", "r").coalesce(1).sortWithinPartitions("rank").write.option("sep", "\t").csv(f"{path}/merges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    vocab = spark.read.schema("token_id int, token string").json(f"{path}/vocab")
    merges = spark.read.schema("rank int, l string, r string").option("sep", "\t").csv(f"{path}/merges")
    return vocab, merges


def from_letters(token: Column) -> Column:
    """Hex of a token written in the byte-to-letter table."""
    table = F.create_map(*[x for b, c in byte_letters().items() for x in (F.lit(c), F.lit(f"{b:02X}"))])
    return F.array_join(F.transform(F.split(token, ""), lambda c: F.try_element_at(table, c)), "")


def to_letters(token: Column) -> Column:
    """A hex token in the byte-to-letter table."""
    table = F.create_map(*[x for b, c in byte_letters().items() for x in (F.lit(f"{b:02X}"), F.lit(c))])
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(token), F.lit(2)), lambda i: F.try_element_at(table, F.substring(token, i, F.lit(2)))), "")


def import_letters(spark: SparkSession, vocab_path: str, merges_path: str, specials: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """vocab and merges from a one-object JSON (token to id) and lines ``left right``; lines without two fields are skipped, missing specials appended."""
    text = spark.read.text(vocab_path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,int>")).alias("t", "token_id"))
    vocab = entries.select("token_id", from_letters(F.col("t")).alias("token"))
    own = [s.encode().hex().upper() for s in specials or []]
    have = {r["token"] for r in vocab.where(F.col("token").isin(own or [""])).collect()}
    n = vocab.count()
    more = [(n + i, t) for i, t in enumerate([t for t in own if t not in have])]
    if more:
        vocab = vocab.unionByName(spark.createDataFrame(more, "token_id int, token string"))
    rows = spark.read.text(merges_path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.size(F.split(x, " ")) == 2)).alias("rank", "line"))
    merges = rows.select("rank", from_letters(F.split("line", " ")[0]).alias("l"), from_letters(F.split("line", " ")[1]).alias("r"))
    return vocab, merges


def config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a model configuration; fields that the schema doesn't name are left out."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def plain_names(params: DataFrame) -> DataFrame:
    """Parameter names without the prefix that compiled models add."""
    return params.withColumn("name", F.regexp_replace("name", r"^_orig_mod\.", ""))


def shapes(config: dict) -> dict[str, tuple[int, int]]:
    """Rows and columns of every parameter of a configured model; gains are one row."""
    v, d, ff = config["vocab_size"], config["d_model"], config["d_ff"]
    out = {"embedding": (v, d), "head": (v, d), "ln_final": (1, d)}
    for n in range(config["num_layers"]):
        layer = {**{c: (d, d) for c in "qkvo"}, "w1": (ff, d), "w3": (ff, d), "w2": (d, ff), "ln1": (1, d), "ln2": (1, d)}
        out |= {f"layers.{n}.{k}": s for k, s in layer.items()}
    return out


CONFIG = "vocab_size int, context_length int, d_model int, num_layers int, num_heads int, d_ff int, rope_theta double"


def save_model(params: DataFrame, config_row: DataFrame, path: str) -> None:
    """path/parameters: name, i, j, v; path/config: one JSON object."""
    params.select("name", "i", "j", "v").write.parquet(f"{path}/parameters")
    config_row.coalesce(1).write.json(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """The configuration, and the parameters as a tree for the Transformer kernels: embedding, head, ln_final and layers by number.

    Names lose the prefix of compiled models. A name that the configuration doesn't have, one that is missing, and a matrix with
    missing, repeated or further cells raise an error before any cell comes to the driver; what comes is the model.
    """
    settings = config(spark, f"{path}/config", CONFIG).head().asDict()
    want = shapes(settings)
    params = plain_names(spark.read.parquet(f"{path}/parameters"))
    have = {r["name"]: r for r in params.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("cells"), F.max("i").alias("i"), F.max("j").alias("j")).collect()}
    if unknown := sorted(set(have) - set(want)):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    if missing := sorted(set(want) - set(have)):
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    for name, (rows, columns) in want.items():
        r = have[name]
        if not r["n"] == r["cells"] == rows * columns or (r["i"], r["j"]) != (rows - 1, columns - 1):
            raise ValueError(f"{name} is not {rows} by {columns}")
    tree: dict = {"layers": [{} for _ in range(settings["num_layers"])]}
    for name, cells in params.select("name", "i", "j", "v").toPandas().groupby("name"):
        m = np.zeros(want[name])
        m[cells["i"], cells["j"]] = cells["v"]
        m = m[0] if name.rpartition(".")[2].startswith("ln") else m
        if name.startswith("layers."):
            _, n, own = name.split(".")
            tree["layers"][int(n)][own] = m
        else:
            tree[name] = m
    return settings, tree
