"""Training and counting of large vocabularies in phases, against plain loops."""

import random

import numpy as np
import pytest

from tests.test_merging import plain_encode, plain_train
from tokenloom.operators import bpe, word_blocks, word_phases
from tokenloom.operators.merging import ranked
from tokenloom.plans import text_queries as T


def random_words(seed, letters="aab-é\x00", n=300):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randrange(1, 14))): r.randrange(1, 9) for _ in range(n)}


def plain_counts(counts, merges):
    ids = {f"{b:02X}": b for b in range(256)} | {left + right: 256 + k for k, (left, right, _) in enumerate(merges)}
    ranks, out = ranked([m[:2] for m in merges]), {}
    for word, n in counts.items():
        for t in plain_encode([f"{b:02X}" for b in word.encode()], ranks):
            out[ids[t]] = out.get(ids[t], 0) + n
    return out


@pytest.mark.parametrize("places", [1, 60, 400, 1 << 22])
@pytest.mark.parametrize("pairs", [2, 12, 1 << 18])
def test_phases_equal_plain_training(spark, places, pairs, monkeypatch):
    """Few and many merges a phase, ties at the bound, runs of one token, tokens made twice."""
    monkeypatch.setattr(bpe, "PHASE_PLACES", places)
    monkeypatch.setattr(bpe, "PHASE_PAIRS", pairs)
    monkeypatch.setattr(bpe, "PHASE_IDS", 8 * places)
    counts = random_words(places)
    blocks = bpe.stored_blocks(spark.createDataFrame(list(counts.items()), "word string, cnt long").repartition(3))
    merges = 12 if places == 1 or pairs == 2 else 80
    got = bpe.train_phases(blocks, merges)
    assert got == plain_train(counts, merges)
    assert {r["token_id"]: r["n"] for r in bpe.block_token_counts(blocks, got).collect()} == plain_counts(counts, got)


def test_merging_ends_when_no_pair_is_left(spark):
    counts = {"aaaa": 3, "ab": 2, "c": 5}
    blocks = bpe.stored_blocks(spark.createDataFrame(list(counts.items()), "word string, cnt long"))
    assert bpe.train_phases(blocks, 100) == plain_train(counts, 100)
    none = bpe.stored_blocks(spark.createDataFrame([], "word string, cnt long"))
    assert bpe.train_phases(none, 100) == [] and bpe.block_token_counts(none, []).collect() == []


def test_words_in_a_block_are_encoded_as_one_by_one():
    for seed in range(30):
        r, counts = random.Random(seed), random_words(seed, "aabc", 60)
        merges = []
        while len(merges) < 14:  # some pairs twice, some tokens in two ways
            parts = ["61", "62", "63", *("".join(m) for m in merges)]
            merges.append((r.choice(parts), r.choice(parts)))
        names = word_blocks.Names()
        steps = [names.step(*m) for m in merges]
        ids, weights = word_phases.encoded(word_blocks.flat(list(counts), np.array([*counts.values()])), steps)
        ends = np.flatnonzero(ids == 0)
        got = sorted((tuple(names.names[i] for i in ids[a:b]), int(weights[b])) for a, b in zip([0, *ends + 1], ends))
        assert got == sorted((tuple(plain_encode([f"{b:02X}" for b in w.encode()], ranked(merges))), n) for w, n in counts.items())


def test_token_frequencies_take_a_whole_vocabulary(spark, sf_dir):
    """Far more ids than a few merges make, and the same as encoding text by text counts."""
    got = {r["token_id"]: r["n"] for r in T.bpe_token_freq(spark, sf_dir).collect()}
    assert T.VOCABULARY == 10_000 and max(got) >= 9_900 and len(got) > 9_000
    docs = T.docs(spark, sf_dir)
    merges = bpe.train_phases(bpe.stored_blocks(bpe.pretoken_counts(docs)), T.VOCABULARY - 256)
    vocab = dict(enumerate([*(f"{b:02X}" for b in range(256)), *(left + right for left, right, _ in merges)]))
    parts = bpe.token_parts(docs, bpe.Tokenizer(vocab, [m[:2] for m in merges])).groupBy("token_id").sum("n")
    assert got == {r[0]: r[1] for r in parts.collect()}
