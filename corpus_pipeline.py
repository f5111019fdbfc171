"""A training corpus from documents: quality, language, near-duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import language, mixing, near_dup, packing, quality
from tokenloom.llm.common import written
from tokenloom.llm.queries import table, tokenizer
from tokenloom.session import ship

#: Share of a text's language under the model below which the language stage rejects it.
LEAST_LANGUAGE_SCORE = 0.5
#: Workers have served four stages before the last; its cache is a smaller one.
CACHED_CHUNKS = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    ship(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no language that the model is sure of go."""
    ship(spark)
    return language.in_known_language(docs, LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    ship(spark)
    return near_dup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, by Poisson draws with the mean of their source's rate."""
    ship(spark)
    return mixing.replicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, at the mixture's shares in every sequence."""
    ship(spark)
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), held=CACHED_CHUNKS)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The field, the language model and the tokenizer have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
