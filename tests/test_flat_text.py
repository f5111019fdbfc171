"""Pre-tokens and merges over many texts in one flat array, against the pattern and word-by-word merging."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tokenloom.functions import flat_text
from tokenloom.functions.text import PRETOKEN
from tokenloom.operators import bpe
from tokenloom.operators.bpe import Tokenizer

LETTERS = "aZé1٣²½'' \n\t\u00a0\u3000.#-🙃字sdmtlvre\u001c\u0085\u0301\u200b"


def texts_of(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(14))) for _ in range(n)]


def tokenizer_of(merges):
    vocab = {i: f"{i:02X}" for i in range(256)}
    vocab |= {256 + k: a + b for k, (a, b) in enumerate(merges)}
    return Tokenizer(vocab, merges)


def test_words_begin_where_the_pattern_cuts():
    for seed in range(3000):
        texts = texts_of(seed, seed % 5)
        data, ends = flat_text.text_bytes(pa.array(texts, pa.string()))
        at = [*np.flatnonzero(flat_text.word_starts(data, ends[:-1][np.diff(ends) > 0])).tolist(), len(data)]
        assert [data[i:j].tobytes().decode() for i, j in zip(at, at[1:])] == [w for t in texts for w in regex.findall(PRETOKEN, t)]


def test_texts_of_a_slice_and_broken_ones():
    data, ends = flat_text.text_bytes(pa.array(["x", None, "é", "", "ab"]).slice(1))
    assert data.tobytes() == "éab".encode() and ends.tolist() == [0, 0, 2, 2, 4]
    assert flat_text.text_bytes(pa.array([], pa.string()))[1].tolist() == [0]
    halves = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 1, 2], np.int32)), pa.py_buffer("é".encode()))
    for broken in (halves, halves.slice(0, 1)):
        with pytest.raises(ValueError):
            flat_text.text_bytes(broken)


def test_few_merges_take_no_word_by_itself(monkeypatch):
    """Workers once merged each new word alone and forgot all of them beyond KNOWN_WORDS, so time grew faster than the texts."""
    r = random.Random(1)
    for seed in range(60):
        made, merges = [f"{b:02X}" for b in " aer'\n\xe9".encode()], []
        for _ in range(12):
            pair = r.choice(made), r.choice(made)
            if "".join(pair) not in made:
                merges.append(pair)
                made.append("".join(pair))
        tok, texts = tokenizer_of(merges), [*texts_of(seed, 20), None, "", " aa aaa aaaa areare" * 3]
        assert tok.merger is not None
        want = [[i for w in regex.findall(PRETOKEN, t or "") for i in tok.word(w)] for t in texts]
        monkeypatch.setattr(Tokenizer, "word", None)
        for held in (4, 64, 1 << 22):
            monkeypatch.setattr(bpe, "HELD_BYTES", held)
            parts = list(bpe.coded([pa.record_batch({"text": pa.array(texts)})], tok))
            assert [ids.tolist() for _, rows in parts for ids in rows] == want and all(b.num_rows == len(rows) for b, rows in parts)
        monkeypatch.undo()


def test_merges_out_of_order_go_word_by_word():
    a, b = "61", "62"
    for merges in ([(a + b, a), (a, b)], [(a, b), (a + b, a), (a, b + a), (b, a)], [(a, b), (b, a), (a, b)]):
        assert flat_text.Merger.of(tokenizer_of(merges).ids, merges) is None
    many = [(a * k, a) for k in range(1, flat_text.Merger.MOST + 2)]
    assert flat_text.Merger.of(tokenizer_of(many).ids, many) is None
    assert flat_text.Merger.of({"61": 0}, []) is None  # no id of another byte: an error only where one is met


def test_pretokens_are_counted_before_they_are_rows(spark):
    """Each pre-token of each text was a row of its own before it was counted."""
    texts = [*texts_of(7, 300), None, "", "a" * 70 + " b" * 70]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = bpe.pretoken_counts(df)
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for w in (w for t in texts for w in regex.findall(PRETOKEN, t or "")):
        want[w] = want.get(w, 0) + 1
    assert {r["word"]: r["cnt"] for r in counts.collect()} == want
    broken = spark.sql("SELECT decode(x'41', 'UTF-8') AS text UNION ALL SELECT cast(x'41FF' AS string)")
    assert {r["word"]: r["cnt"] for r in bpe.pretoken_counts(broken).collect()} == {"A": 2, "\ufffd": 1}
    piece = spark.createDataFrame([("ab<|e|>ab c",)], "text string")
    assert {r["word"]: r["cnt"] for r in bpe.pretoken_counts(piece, ["<|e|>"]).collect()} == {"ab": 2, " c": 1}
    assert bpe.pretoken_counts(df.limit(0)).count() == 0


def test_counts_of_ids_come_once_a_task(spark):
    """A task gives a row an id, not one for each few megabytes of its texts."""
    tok, texts = tokenizer_of([("61", "61")]), ["aaab " * 60_000] * 12
    parts = bpe.token_parts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), tok)
    n = 12 * 60_000
    assert sorted(parts.collect()) == [(32, n), (97, n), (98, n), (256, n)]


def test_decoding_takes_no_expression_an_id(spark):
    """Each id was looked up, written as digits and joined by an expression of its own."""
    vocab = {0: "C3", 1: "A9", 3: "616263", 4: ""}
    lists = [[3, 0, 1], [], None, [0], [4, 3, 4], [0, 1] * 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, ids array<int>").repartition(2)
    out = df.select("i", bpe.decode(F.col("ids"), vocab).alias("t"))
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert dict(map(tuple, out.collect())) == {0: "abcé", 1: "", 2: None, 3: "�", 4: "abc", 5: "é" * 5}
    for ids in ([2], [5], [-1], [None]):
        with pytest.raises(Exception, match="unknown token id"):
            spark.createDataFrame([([3],), (ids,)], "ids array<int>").select(bpe.decode(F.col("ids"), vocab)).collect()
