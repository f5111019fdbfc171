"""Queries of the training-data operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprints, language, mixing, near_dup, packing, quality, repair, sharding, token_counts, token_files, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; the package that names it stands beside the library, not in it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # target mixture: the sources' tokens to the power that mixing uses
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), alpha=mixing.ALPHA)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")), "gone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_near_dup": op4_near_dup,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_chat": op10_chat,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op5_mixing": mixing.oracle(),
    "op11_decontamination": decontaminate.oracle(),
}
