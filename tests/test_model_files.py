"""Loading a whole model: names and shapes are checked against its configuration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.plans import train_queries as Q
from tokenloom.plans.tensor_queries import HEADS, SEQ, THETA, VOCAB, D, lm_weights
from tokenloom.sources import vocab
from tokenloom.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def params(spark):
    return Q.pretrained(spark).cache()


def saved(spark, params):
    path = scratch_path(spark, "model")
    vocab.save_model(params, spark.createDataFrame([(VOCAB, SEQ, D, 2, HEADS, 128, THETA)], vocab.CONFIG), path)
    return path


def test_a_saved_model_comes_back(spark, params):
    settings, tree = vocab.load_model(spark, saved(spark, params))
    want = lm_weights()
    assert settings["num_heads"] == HEADS and sorted(tree) == sorted(want) and len(tree["layers"]) == 2
    assert all(np.array_equal(tree[k], want[k]) for k in ("embedding", "head", "ln_final"))
    assert all(np.array_equal(a[k], b[k]) for a, b in zip(tree["layers"], want["layers"]) for k in b)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda p: p.where("name != '_orig_mod.layers.1.w2'"), "missing parameters: layers.1.w2"),
        (lambda p: p.withColumn("name", F.regexp_replace("name", "head", "tail")), "unknown parameters: tail"),
        (lambda p: p.where("NOT (name = '_orig_mod.head' AND i = 3 AND j = 5)"), "head is not"),
        (lambda p: p.unionByName(p.where("name = '_orig_mod.ln_final' AND j = 0")), "ln_final is not"),
    ],
)
def test_wrong_parameters_raise(spark, params, change, message):
    with pytest.raises(ValueError, match=message):
        vocab.load_model(spark, saved(spark, change(params)))
