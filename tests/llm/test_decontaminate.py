"""Benchmark decontamination against a plain search of every window."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests import compare
from tokenloom.llm import decontaminate
from tokenloom.llm.queries import op11_decontamination

ITEMS = "item_id long, text string"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    """(n_words, hit positions, ids) of every document."""
    out = []
    split = [(i, w) for i, t in items if (w := plain_words(t))]
    for _, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for i, v in split:
            m = min(width, len(v))
            wins = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)}
            found = [k for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in wins]
            hit.update(k + j for k in found for j in range(m))
            ids |= {i} if found and i is not None else set()
        out.append((len(w), hit, ids))
    return out


def expected(docs, items, width=10):
    rows = []
    for (i, _), (n, hit, ids) in zip(docs, brute(docs, items, width)):
        names = ",".join(sorted(map(str, ids)))
        rows.append((i, n, len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


def got(spark, docs, items, width=10):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    return sorted((tuple(r) for r in decontaminate.digests(d, b, width).collect()), key=str)


P = "Alpha beta GAMMA delta eps zeta eta theta iota kappa lambda mu"
EDGE_ITEMS = [(1, P), (1, "one two"), (2, "É É ß Σ σΣ"), (3, None), (4, " ,. "), (None, "no name here"), (10, "ein " * 30), (11, "one two"), (12, "K k")]
EDGE_DOCS = [
    (1, "x " + P.upper().replace(" ", " - ") + ", y"), (2, None), (3, ""), (4, " \n,;"), (5, "one. TWO one two two one two"), (6, "é É ß Σ σΣ É É SS Σ σΣ É é ß σ σσ É É ß Σ σΣ"), (7, "has no name here."), (8, "ein " * 5000 + "zwei"),
    (9, " ".join(P.split()[:9])), (10, " ".join(P.split()[1:11])), (None, "one two"), (None, "one two"), (5, "other words"), (5, "other words"), (12, "K K k k K"), (13, "word " * 60_000 + P + " end"),
]


def test_edges(spark):
    assert got(spark, EDGE_DOCS, EDGE_ITEMS) == expected(EDGE_DOCS, EDGE_ITEMS)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("aAbB") + r.choice([" ", "  ", ".\n", ", "]) for _ in range(n))
    docs = [(i, text(r.randrange(40))) for i in range(60)]
    items = [(i, text(r.choice([1, 2, 3, 5, 6, 9]))) for i in range(12)]
    assert got(spark, docs, items, 5) == expected(docs, items, 5)


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "MOST_CELLS", 64)  # a full bit set lets every window pass
    assert got(spark, EDGE_DOCS, EDGE_ITEMS) == expected(EDGE_DOCS, EDGE_ITEMS)


def test_empty_tables(spark):
    assert got(spark, [], EDGE_ITEMS) == []
    assert got(spark, EDGE_DOCS, []) == expected(EDGE_DOCS, [])


def test_cleaned_removes_spans_or_documents(spark):
    docs = spark.createDataFrame(EDGE_DOCS, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    items = spark.createDataFrame([*EDGE_ITEMS, (40, "second thing")], ITEMS).withColumn("width", F.lit("clash"))
    spans = decontaminate.cleaned(docs, items, most_share=0.9)
    assert spans.columns == docs.columns
    left = {}
    for r in spans.collect():
        left.setdefault(r["doc_id"], []).append(r["text"])
    whole = brute(EDGE_DOCS, EDGE_ITEMS)
    for (i, text), (n, hit, _) in zip(EDGE_DOCS, whole):
        if len(hit) > 0.9 * n:
            assert i is None or text not in left.get(i, [])
        elif not hit:
            assert text in left[i]
    assert left[1] == ["x, y"] and left[7] == ["has."] and left[13] == ["word " * 59_999 + "word end"]
    kept = sorted((r["doc_id"], r["text"]) for r in decontaminate.cleaned(docs, items, most_share=0.0).collect())
    assert kept == sorted((i, t) for (i, t), (_, hit, _) in zip(EDGE_DOCS, whole) if not hit) if None not in {t for _, t in kept} else len(kept) == sum(not hit for _, hit, _ in whole)


def test_query_equals_oracle(spark, sf_dir):
    con = compare.connect(sf_dir)
    rows = compare.rows(op11_decontamination(spark, sf_dir).toPandas())
    assert rows == compare.rows(con.sql(decontaminate.oracle()).df()) and any(r[0] for r in rows[1])


def test_plan_is_native(spark, sf_dir):
    plan = op11_decontamination(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
