import re
from collections import Counter
from itertools import product

import numpy as np

from tokenloom.llm import quality
from tokenloom.llm.words import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    dup, earlier = 0, set()
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in earlier
        earlier.add(line)
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def test_figures_and_verdicts(docs, labels, rows):
    got = {r["doc_id"]: r.asDict() for r in quality.judged(docs, labels).collect()}
    assert set(got) == set(rows)
    for d, r in rows.items():
        want = brute(r["text"])
        assert {k: got[d][k] for k in want} == want, d
        assert not (got[d]["kept"] and got[d]["base_failed"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [d for d in truth if d in got and not got[d]["base_failed"]]
    right = sum(got[d]["kept"] == bool(truth[d]) for d in judged)
    assert right >= 0.95 * len(judged)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(50):
        field = quality.LineField(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(int(rng.integers(1, 8)), quality.FEATURES))
        e = x @ field.weights
        score = lambda y: sum(e[i, v] for i, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        assert tuple(field.content(x)) == max(product((0, 1), repeat=len(x)), key=score)
    assert field.content(x[:0]) == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, t, n = rng.normal(size=(2, 4, 2)), rng.normal(size=(2, 2)), [4, 2]
    live = np.arange(4)[None] < np.array(n)[:, None]
    node, pair = quality.LineField._marginals(e, t, live)
    for s in range(2):
        every = list(product((0, 1), repeat=n[s]))
        w = np.array([np.exp(sum(e[s, i, v] for i, v in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))) for y in every])
        w /= w.sum()
        for i, v in product(range(n[s]), (0, 1)):
            assert np.isclose(node[s, i, v], sum(p for p, y in zip(w, every) if y[i] == v))
        for i, a, b in product(range(n[s] - 1), (0, 1), (0, 1)):
            assert np.isclose(pair[s, i, a, b], sum(p for p, y in zip(w, every) if y[i] == a and y[i + 1] == b))


def brute_labels(x, field):
    """The best of all label sequences of a short text."""
    e = x @ field.weights
    score = lambda y: sum(e[i, v] for i, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
    return max(product((0, 1), repeat=len(x)), key=score)


def test_verdicts_by_brute_force(docs, labels, rows):
    field = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    inner = 0
    for d, r in rows.items():
        _, x, words, _, _ = quality.measure([(r["text"] or "").encode()], WordHashes(), field.recurring)
        if got[d]["base_failed"] or len(x) > 12:
            continue
        content = sum(w for w, y in zip(words.tolist(), brute_labels(x, field)) if y) / got[d]["n_words"]
        assert got[d]["content_share"] == content and got[d]["kept"] == (content >= quality.SHARE)
        inner += 0 < content < 1
    assert inner > 10


def test_planted_boilerplate_inside_good_documents_is_marked(spark, labels, docs):
    prose = "the house by the river was quiet and the people who lived there went to bed early because the work began at dawn."
    junk = "$$$ click here *** | now | %%% free ### offer &&& | call | $$$ only *** today %%%"
    second = "every morning they walked along the water to the mill, and in the evening they came home with flour on their coats."
    third = "in winter the mill stood still, so the younger ones learned to read while the older ones told of other winters."
    text = "\n".join([prose, second, junk, "*** best ### price $$$ | order | here %%% and *** win &&& more $$$", third])
    field = quality.train(docs, labels)
    _, x, words, _, _ = quality.measure([text.encode()], WordHashes(), field.recurring)
    assert field.content(x) == [1, 1, 0, 0, 1]
    got = quality.judge([text.encode()], field, WordHashes(), quality.SHARE)
    assert got["kept"][0] and 0.5 < got["content_share"][0] < 0.9


def test_lines_recur_between_different_neighbours():
    n = lambda *v: np.array(v, dtype=np.uint64)
    texts = [n(10 + i, 7, 30 + i) for i in range(6)] + [n(1, 2, 3)] * 50
    assert quality.recurring_lines(texts, [np.full(3, 4)] * 56) == {7}
    assert quality.recurring_lines(texts, [np.full(3, 40)] * 56) == frozenset()


def test_labels_of_lines_are_learned_from_those_of_documents():
    """Two kinds of lines; a third of a bad document's lines are of the good kind, as are most of a good one's."""
    rng = np.random.default_rng(5)
    line = lambda good: np.concatenate([[1.0, good + rng.normal(0, 0.1)], np.zeros(quality.FEATURES - 2)])
    truth = [[1, 1, 1, 0, 1] if i % 2 else [0, 1, 0, 0, 0, 1] for i in range(60)]
    sequences = [np.array([line(y) for y in t]) for t in truth]
    field = quality.LineField.learn(sequences, [np.full(len(t), 10) for t in truth], [i % 2 for i in range(60)])
    got = [field.content(s) for s in sequences]
    assert sum(g == t for g, t in zip(got, truth)) >= 57


def test_edges(edges, empty, clashing, labels):
    got = {r["doc_id"]: r for r in quality.judged(edges, labels).collect()}
    for r in edges.collect():
        want = brute(r["text"])
        assert {k: got[r["doc_id"]][k] for k in want} == want
    assert quality.judged(empty, labels).count() == 0
    none = labels.limit(0)
    assert {r["kept"] for r in quality.judged(edges.where("doc_id = 1"), none).collect()} == {True}
    kept = quality.good(clashing, labels)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} <= {1, 2, 6, 7, 8, 11}


def test_batches_do_not_change_figures(rows):
    texts = [(r["text"] or "").encode() for r in rows.values()][:60]
    whole, *_ = quality.measure(texts, WordHashes())
    for i, t in enumerate(texts):
        one, *_ = quality.measure([t], WordHashes(held=10))
        assert all(one[k][0] == whole[k][i] for k in whole)
