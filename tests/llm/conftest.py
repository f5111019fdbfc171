import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))  # about 60,000 words
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog again and again until it is tired of jumping over dogs today", "en", "a"),
    (2, "The QUICK brown fox jumps over the lazy dog again and again until it is tired of jumping over dogs today", "en", "a"),
    (3, None, "en", "a"),
    (4, "", "de", None),
    (5, " \n\t ", None, "b"),
    (6, LONG, "en", "a"),
    (7, LONG + " end", "en", "b"),
    (8, "über größe straße 😀 naïve 漢字 kana かな " * 6, "de", "b"),
    (9, "one\ntwo\n\none\ntwo", "de", "c"),
    (10, "12 34 !!", "fr", "c"),
    (11, "le chat noir dort sur la chaise pendant que le chien regarde par la fenêtre ouverte du salon bleu", "fr", "c"),
    (12, "four words only here", "en", "c"),
    (13, "Four Words only HERE", "en", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, a repeated row."""
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in EDGES]
    return spark.createDataFrame([*rows, rows[0]], COLUMNS)


@pytest.fixture(scope="session")
def unique(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in EDGES], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(unique):
    """Further columns with the names that operators use."""
    from pyspark.sql import functions as F

    names = ["part", "seq", "before", "ids", "node", "sig", "key", "comp", "queue", "task", "at", "n", "score", "kept", "shard", "slot", "size", "copy", "rate", "words", "lines", "y", "x", "edited", "slots", "bytes", "weight", "block", "set_key", "virtual_slot", "lang_pred", "held_out"]
    return unique.select("*", *[F.lit("clash").alias(c) for c in names])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
