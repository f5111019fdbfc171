"""Language-model training: gradients by finite differences, bigram steps by plain numpy, initialisation by moments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import dense, gradients, init
from tokenloom.operators import lm, optim

V, D, FF, HEADS = 11, 8, 12, 2


@pytest.fixture(scope="module")
def params(spark):
    return lm.initial(spark, V, D, FF, 2, 3).cache()


def test_gradients_by_finite_differences(params):
    w = {k: m.astype(float) for k, m in lm.matrices(params).items()}
    r = np.random.default_rng(1)
    x, y = r.integers(0, V, size=(3, 5)), r.integers(0, V, size=(3, 5))
    loss, grads = gradients.loss_and_gradients(x, y, w, HEADS)
    for name, m in w.items():
        for _ in range(4):
            at = tuple(int(r.integers(0, s)) for s in m.shape)
            value, sides = m[at], []
            for step in (1e-5, -1e-5):
                m[at] = value + step
                sides.append(gradients.loss_and_gradients(x, y, w, HEADS, gradients=False)[0])
            m[at] = value
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-5, abs=1e-7), name
    layers = [{k.rpartition(".")[2]: (m[0] if k.endswith(("ln1", "ln2")) else m) for k, m in w.items() if k.startswith(f"layers.{n}.")} for n in range(2)]
    plain = {"embedding": w["embedding"], "head": w["head"], "ln_final": w["ln_final"][0], "layers": layers}
    p = [dense.softmax(dense.language_model(ids, plain, HEADS)) for ids in x]
    assert loss == pytest.approx(-sum(math.log(p[b][t, y[b, t]]) for b in range(3) for t in range(5)))


def test_training_lowers_the_loss_and_sums_over_partitions(spark, params):
    text = [ord(c) % V for c in "the cat sat on the mat and the dog sat on the log " * 6]
    rows = [(text[i : i + 8], text[i + 1 : i + 9]) for i in range(0, len(text) - 9, 4)]
    windows = spark.createDataFrame(rows, "x array<int>, y array<int>").repartition(5)
    one, loss = lm.lm_gradient(windows.coalesce(1), optim.fresh(params), HEADS)
    many, same = lm.lm_gradient(windows, optim.fresh(params), HEADS)
    assert loss == pytest.approx(same, rel=1e-12)
    assert one.join(many.withColumnRenamed("v", "u"), ["name", "i", "j"]).where(F.abs(F.col("u") - F.col("v")) > 1e-12).count() == 0
    state, log = lm.train_lm(windows, params, HEADS, 3, (0.05, 0.01, 1, 5), 1.0, valid=windows.limit(7), eval_every=2)
    losses = [x["train_loss"] for x in log]
    assert losses[0] == pytest.approx(losses[1]) and losses[2] < losses[1]  # the first rate of a warm-up is 0
    assert [x["valid_loss"] is None for x in log] == [True, False, True] and state.count() == params.count()
    assert lm.lm_loss(windows.limit(0), state, HEADS) is None


def test_bigram_steps_by_numpy(spark):
    rows = [([0, 1, 1, 2, 0, 1],), ([2],), ([],), ([1, 2, 1],)]
    df = spark.createDataFrame(rows, "ids array<int>")
    n = np.zeros((3, 3))
    for (ids,) in rows:
        for a, b in zip(ids, ids[1:]):
            n[a, b] += 1
    w, m, s = np.zeros((3, 3)), np.zeros((3, 3)), np.zeros((3, 3))
    state, log = lm.train_bigram(df, 3, 2, (0.1, 0.1, 0, 1), 0.2, valid=df)
    for t in range(2):
        p = dense.softmax(w)
        assert log[t]["train_loss"] == pytest.approx(-(n * np.log(p)).sum() / n.sum())
        g = (n.sum(axis=1, keepdims=True) * p - n) / n.sum()
        g *= min(1.0, 0.2 / (np.sqrt((g * g).sum()) + 1e-6)) if np.sqrt((g * g).sum()) > 0.2 else 1.0
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w * (1 - 0.1 * 0.01) - 0.1 / (1 - 0.9 ** (t + 1)) * m / (np.sqrt(s / (1 - 0.999 ** (t + 1))) + 1e-8)
    assert lm.matrices(state)["w"] == pytest.approx(w)


def test_truncated_normal(spark):
    u = init.uniform(7, F.lit("w"), F.col("id"), F.col("id") % 13)
    rows = spark.range(40_000).select(init.truncated_normal(u, 2.0).alias("v"), init.truncated_normal(u, 2.0, 1.0).alias("c"))
    got = rows.agg(F.avg("v"), F.stddev("v"), F.max(F.abs("v")), F.max(F.abs("c")), F.countDistinct("v")).head()
    assert abs(got[0]) < 0.05 and abs(got[1] - 1.973) < 0.03 and got[2] <= 6 and got[3] <= 2 and got[4] > 39_990
    ps = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.99999]
    for p, z in spark.createDataFrame([(p,) for p in ps], "p double").select("p", init.inverse_normal(F.col("p"))).collect():
        assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, rel=1e-7)
