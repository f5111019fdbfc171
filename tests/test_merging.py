"""Distributed byte-pair training and merges on one word, against plain loops."""

import random

import pytest

from tokenloom.operators import bpe, word_blocks
from tokenloom.operators.merging import merge_word, ranked


def one_pass(tokens, pair):
    out, i = [], 0
    while i < len(tokens):
        hit = tuple(tokens[i : i + 2]) == pair
        out.append("".join(pair) if hit else tokens[i])
        i += 2 if hit else 1
    return out


def plain_encode(tokens, ranks):
    while len(tokens) > 1:
        best = min(zip(tokens, tokens[1:]), key=lambda p: ranks.get(p, [1 << 60])[0])
        if best not in ranks:
            break
        tokens = one_pass(tokens, best)
    return tokens


def plain_train(counts, merges):
    words, out = {w: [f"{b:02X}" for b in w.encode()] for w in counts}, []
    for _ in range(merges):
        total = {}
        for w, n in counts.items():
            for p in zip(words[w], words[w][1:]):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        best = max(total, key=lambda p: (total[p], p))
        out.append((*best, total[best]))
        words = {w: one_pass(t, best) for w, t in words.items()}
    return out


def test_merges_on_a_word():
    r = random.Random(3)
    for _ in range(400):
        merges = []
        while len(merges) < 12:  # pairs of letters and of earlier tokens, some twice
            parts = ["a", "b", "c", *("".join(m) for m in merges)]
            merges.append((r.choice(parts), r.choice(parts)))
        ranks, tokens = ranked(merges), [r.choice("abc") for _ in range(r.randrange(30))]
        assert merge_word(tokens, ranks) == plain_encode(tokens, ranks)
        replayed = tokens
        for k, m in enumerate(merges):
            assert merge_word(tokens, ranks, k, replay=True) == replayed
            replayed = one_pass(replayed, m)


def test_a_long_run_takes_no_squared_time():
    merges = [("a" * 2**k, "a" * 2**k) for k in range(10)]
    assert [len(t) for t in merge_word(["a"] * 300_000, ranked(merges))][:2] == [1024, 1024]


def counted(spark, counts):
    return bpe.word_tokens(spark.createDataFrame(list(counts.items()), "word string, cnt long"))


@pytest.mark.parametrize("counts", [{"aaa": 100, "cd": 90}, {"aaaa": 7, "aaaaa": 5, "aab": 6, "baa": 6, "abab": 9}, {"----": 4, "---": 9, "==": 5, "====": 3, "-=-=": 6}], ids=["triple", "runs", "rules"])
def test_rounds_on_runs_of_one_token(spark, counts):
    assert bpe.train_rounds(counted(spark, counts), 12) == plain_train(counts, 12)


@pytest.mark.parametrize("most", [4, 256])
def test_rounds_on_random_words(spark, most, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_DELTAS", 2)
    r = random.Random(most)
    counts = {"".join(r.choice("aab-é") for _ in range(r.randrange(1, 9))): r.randrange(1, 30) for _ in range(60)}
    assert bpe.train_rounds(counted(spark, counts), 16, most) == plain_train(counts, 16)


def test_a_batch_ends_at_a_pair_of_one_token():
    assert bpe.independent([("61", "61", 9), ("62", "63", 8)], set(), True) == [("61", "61", 9)]


def test_blocks_of_words_equal_plain_training():
    """One task and rounds share the flat blocks: runs, repeated ids and wide vocabularies against plain loops, no object a token."""
    r = random.Random(8)
    counts = {"".join(r.choice("aab\x00é") for _ in range(r.randrange(1, 12))): r.randrange(1, 9) for _ in range(300)}
    words = list(counts)
    for table in (word_blocks.TABLE_IDS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(word_blocks, "TABLE_IDS", table)
            blocks = [word_blocks.flat(words[i : i + 70], [counts[w] for w in words[i : i + 70]]) for i in range(0, 300, 70)]
            names = word_blocks.Names()
            for left, right, n in plain_train(counts, 30):
                assert word_blocks.most_frequent(blocks, names.names, 1) == [(left, right, n)]
                step = names.step(left, right)
                blocks = [word_blocks.merged(b, *step) for b in blocks]
    assert all(ids.dtype == "uint32" and weights.dtype == "int64" for ids, weights in blocks)


def test_one_task_and_rounds_agree_over_many_merges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(40)
    one = [tuple(x)[1:] for x in bpe.train(docs, 60).orderBy("rank").collect()]
    assert one == [tuple(x)[1:] for x in bpe.train(docs, 60, one_task_words=0).orderBy("rank").collect()] and len(one) == 60
