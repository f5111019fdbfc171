import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import language


@pytest.fixture(scope="module")
def predicted(docs):
    return {r["doc_id"]: r for r in language.identified(docs).collect()}


def test_accuracy_on_held_out_documents(predicted, rows):
    assert set(predicted) == set(rows)
    assert all(p["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= p["score"] <= 1 for d, p in predicted.items())
    unseen = [d for d, p in predicted.items() if p["held_out"]]
    assert sum(predicted[d]["lang_pred"] == rows[d]["lang"] for d in unseen) >= 0.97 * len(unseen)


def plain_counts(texts):
    """Counts of words (order 0) and of n-grams by language, told plainly."""
    out = defaultdict(lambda: defaultdict(Counter))
    for lang, text in texts:
        for w in language.WORD.findall(text.lower()):
            out[0][w][lang] += 1
            p = f"^{w}$"
            for k in language.ORDERS:
                for i in range(len(p) - k + 1):
                    out[k][p[i : i + k]][lang] += 1
    return out


def test_scores_equal_a_plain_backoff(predicted, rows):
    """Training counts, backoff and scores by brute force; the sample holds all documents here."""
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in rows}
    counts = plain_counts((r["lang"], r["text"]) for d, r in rows.items() if not held[d] and r["lang"] and r["text"])
    langs = sorted({r["lang"] for d, r in rows.items() if not held[d] and r["lang"]})
    below = {k: [sum(c[g] for c in counts[k].values()) + 0.5 * len(counts[k]) for g in langs] for k in counts}
    row = lambda k, x: [math.log((counts[k][x][g] + 0.5) / b) for g, b in zip(langs, below[k])]
    for d in sorted(rows)[:60]:
        total, words = [0.0] * len(langs), language.WORD.findall(rows[d]["text"].lower())
        for w in words:
            score, p = row(0, w) if w in counts[0] else None, f"^{w}$"
            for k in language.ORDERS:
                if score is None:
                    hits = [row(k, x) for x in (p[i : i + k] for i in range(len(p) - k + 1)) if x in counts[k]]
                    score = [sum(h) / len(hits) for h in zip(*hits)] if hits else None
            total = [t + x for t, x in zip(total, score or [0.0] * len(langs))]
        best = max(range(len(langs)), key=lambda i: total[i])
        mean = [language.SHARPNESS * (t - total[best]) / max(1, len(words)) for t in total]
        assert predicted[d]["lang_pred"] == langs[best]
        assert math.isclose(predicted[d]["score"], 1 / sum(map(math.exp, mean)), rel_tol=1e-9)


def test_sparse_scores_are_those_of_tables(docs, rows, monkeypatch):
    model = language.train(docs)
    texts = [r["text"] for r in rows.values()][:40]
    want = [language.Scorer(model).text(t) for t in texts]
    monkeypatch.setattr(language, "DENSE", 0)
    for t, (lang, score) in zip(texts, want):
        got = language.Scorer(model, held=50).text(t)
        assert got[0] == lang and math.isclose(got[1], score, rel_tol=1e-9)


def test_words_keep_their_marks():
    assert language.words_of("Straße é ½x 12") == ["straße", "é", "½x"] and language.words_of("e\u0301X") == ["e\u0301x"]
    assert language.WORD.findall("नमस्ते e\u0301x a1b _c") == ["नमस्ते", "e\u0301x", "a", "b", "c"]


def test_many_languages_stay_small(spark):
    """A model has one entry for each n-gram and language that has it; the sample is bounded over all languages."""
    own = lambda i: chr(97 + i % 300 // 26) + chr(97 + i % 300 % 26)
    df = spark.createDataFrame([(i, f"wort{own(i)} nur{own(i)}", f"l{i % 300:03}") for i in range(1200)], "doc_id long, text string, lang string")
    model = language.train(df, sample_all=600)
    assert len(model["langs"]) == 300
    assert all(len(score) == cuts[-1] <= 600 * 15 for _, cuts, _, score, _ in model["orders"].values())
    scorer = language.Scorer(language.train(df))
    assert scorer.text("wortah nurah")[0] == "l007" and scorer._table.size <= 2 * language.HELD


def test_edges(edges, empty, clashing, docs):
    got = {r["doc_id"]: r for r in language.identified(edges).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (3, 4, 5, 10))
    assert language.identified(edges).count() == edges.count()
    assert language.identified(empty).count() == 0
    numbers = edges.withColumn("text", F.when(F.col("doc_id") == 10, F.lit("½ ² 12 _ !!")).otherwise(F.col("text")))
    assert {r["lang_pred"] for r in language.identified(numbers).collect() if r["doc_id"] == 10} == {"und"}
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identified(unlabelled).collect()} == {"und"}
    assert language.identified(clashing).columns == ["doc_id", "held_out", "lang_pred", "score"]
    kept = language.in_known_language(clashing, 0.5)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 5, 10})


def test_labels_of_held_out_rows_are_not_read(docs):
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in {r["lang_pred"] for r in language.identified(wrong).collect()}
