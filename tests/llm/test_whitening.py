"""Whitening against exact rational arithmetic and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import whitening
from tokenloom.llm.queries import op12_whitening

SHAPE = "vec_id long, embedding array<float>"


def brute(rows):
    """{component: (values of V, trace)}, deviations and whitened by numpy with Python's whole numbers."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, m = len(fit), len(fit[0])
    s = [sum(v[d] for v in fit) for d in range(m)]
    y = [[n * v[d] - s[d] for d in range(m)] for v in fit]
    exact = [[sum(r[a] * r[b] for r in y) for b in range(m)] for a in range(m)]
    v = np.array([[float(Fraction(c, n**3)) for c in r] for r in exact])
    return x, n, s, v, exact


def test_query_by_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x, n, s, v, _ = brute(rows)
    got = {(r["vec_id"], r["component"]): r for r in op12_whitening(spark, sf_dir).collect()}
    assert len(got) == 4 * len(rows)
    values, vectors = np.linalg.eigh(v)
    for k in range(4):
        e, u = values[-1 - k], vectors[:, -1 - k]
        w = np.array([np.dot(np.array([a - b / n for a, b in zip(c, s)]), u) / math.sqrt(e) for _, c in x])
        mine = np.array([got[i, k + 1]["whitened"] for i, _ in x])
        assert min(np.abs(mine - w).max(), np.abs(mine + w).max()) < 1e-9
        assert {got[i, k + 1]["explained"] for i, _ in x} == {got[x[0][0], k + 1]["explained"]}
        assert got[x[0][0], k + 1]["explained"] == pytest.approx(e / np.trace(v), rel=1e-12)
    for i, c in x:
        r = got[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(c, s)) and 0 <= r["identity_error"] < 1e-10


@pytest.mark.parametrize("big", [1 << 10, 1 << 40, (1 << 63) - 1])
def test_gram_is_exact_to_two_doubles(big):
    r = np.random.default_rng(big % 97)
    x = r.integers(-big, big, size=(2500, 5))
    y = whitening.centred(x, 2500, [int(v) for v in x.astype(object).sum(axis=0)], big)
    high, low = whitening.gram(y)
    z = y.astype(object)
    for a in range(5):
        for b in range(5):
            true = int((z[:, a] * z[:, b]).sum())
            assert abs(Fraction(high[a, b]) + Fraction(low[a, b]) - true) <= abs(true) * Fraction(1, 2**96) + int((abs(z[:, a]) * abs(z[:, b])).sum()) * Fraction(1, 2**96)


def test_eigenvectors_are_good_to_double_precision():
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.normal(size=(12, 12)))[0]
    a = (q * np.geomspace(1, 1e-10, 12)) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigen(a, np.zeros_like(a))
    wide = a.astype(np.longdouble)
    left = wide @ vectors.astype(np.longdouble) - vectors * values
    assert np.abs(left).max() < 3e-16 and np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-15 and (np.diff(values) <= 0).all()


def test_merging_does_not_depend_on_partitions(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = whitening.fit(whitening.fixed_point(table.coalesce(1)))
    many = whitening.fit(whitening.fixed_point(table.repartition(70)))
    assert one[0].n == many[0].n and (one[0].values == many[0].values).all() and (one[0].vectors == many[0].vectors).all()


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.5, -3.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1.001, 2.001])]
    df = spark.createDataFrame(rows, SHAPE).withColumn("n", F.lit("clash")).withColumn("x", F.lit("clash"))
    got = whitening.by_component(df).collect()
    assert sorted(str(r["vec_id"]) for r in got if r["component"] == 1) == ["1", "2", "2", "9", "None"] and {r["component"] for r in got} == {1, 2}
    assert {r["n"] for r in got} == {3}  # 1 and 9 are one x
    assert whitening.by_component(spark.createDataFrame([], SHAPE)).collect() == []
    same = whitening.by_component(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SHAPE)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(0, None, None, 0.0)] * 4
    huge = whitening.by_component(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [1.0, 1.0])], SHAPE)).collect()
    assert all(r["deviation"] is None or r["vec_id"] == 3 for r in huge) and all(abs(r["whitened"]) < 2 for r in huge if r["component"] == 1)
