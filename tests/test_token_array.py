"""The one token array against a plain list."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import token_array

COLUMNS = "doc_id long, ids array<int>"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    lengths = [0, 1, 2, 7, 8, 9, 16, 40, 300, 0, 3]
    return {i: [rng.randrange(1000) for _ in range(n)] for i, n in enumerate(lengths)}


def test_offsets_and_windows_equal_a_list(spark, texts):
    df = spark.createDataFrame(list(reversed(texts.items())), COLUMNS).repartition(5)
    flat, at, want = [], 0, {}
    for i, ids in texts.items():
        want[i], at = at, at + len(ids)
        flat += ids
    assert {r["doc_id"]: r["start"] for r in token_array.offsets(df).collect()} == want
    for size, context in ((8, 5), (8, 30), (4096, 5)):  # windows shorter and longer than a block
        got = token_array.sampled(df, context, 200, size=size).collect()
        assert sorted(r["sample"] for r in got) == list(range(200))
        assert all(0 <= r["start"] < len(flat) - context for r in got)
        assert all(r["x"] == flat[r["start"] : r["start"] + context] and r["y"] == flat[r["start"] + 1 : r["start"] + context + 1] for r in got)


def test_blocks_make_the_array(spark, texts):
    df = spark.createDataFrame(list(texts.items()), COLUMNS)
    got = token_array.blocks(token_array.offsets(df), 8).orderBy("block").collect()
    flat = sum(texts.values(), [])
    assert [r["block"] for r in got] == list(range(len(got))) and sum((r["ids"] for r in got), []) == flat
    assert all(len(r["ids"]) == 8 for r in got[:-1])


def test_starts_are_uniform_and_reach_the_last(spark):
    n = token_array.starts(15, 5, 20_000, spark).groupBy("start").count().collect()
    assert {r["start"] for r in n} == set(range(10)) and all(abs(r["count"] - 2000) < 200 for r in n)


def test_copies_and_short_rows_are_in_windows(spark):
    rows = [(None, [1, 2, 3]), (None, [1, 2, 3]), (2, [4] * 12), (2, [4] * 12), (2, []), (3, None), (4, [5]), (4, [5]), (4, [6])]
    df = spark.createDataFrame(rows, COLUMNS)
    placed = sorted((r["start"], r["ids"]) for r in token_array.offsets(df).collect())
    flat = [i for _, ids in placed for i in ids]
    assert len(placed) == len(rows) and len(flat) == 33
    for size in (4, 4096):
        got = token_array.sampled(df, 5, 300, size=size).collect()
        assert sorted(r["sample"] for r in got) == list(range(300))
        assert all(r["x"] + r["y"][-1:] == flat[r["start"] : r["start"] + 6] and r["y"] == flat[r["start"] + 1 : r["start"] + 6] for r in got)


def test_windows_carry_no_whole_rows(spark):
    """What is shuffled and spilled stays in proportion to the array; windows once met whole blocks and were sorted with them."""
    df = spark.range(64).select(F.col("id").alias("doc_id"), F.sequence(F.lit(1), F.lit(20_000)).alias("ids"))
    plan = token_array.sampled(df, 64)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_edges(spark):
    odd = spark.createDataFrame([(None, [1, 2]), (3, None), (3, [4, 5]), (3, [4, 5]), (1, [9])], COLUMNS)
    got = sorted((r["start"], r["ids"]) for r in token_array.offsets(odd).collect())
    assert [s for s, ids in got if ids] == [0, 2, 3, 5] and got[-1][0] <= 7 and len(got) == 5
    with pytest.raises(ValueError):
        token_array.sampled(spark.createDataFrame([], COLUMNS), 4)
    with pytest.raises(ValueError):
        token_array.sampled(spark.createDataFrame([(1, [1, 2, 3])], COLUMNS), 3)
