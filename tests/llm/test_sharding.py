import zlib
from collections import Counter, defaultdict

from tokenloom.llm import sharding
from tokenloom.llm.common import scratch_path


def check(got, texts):
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in texts)
    text = dict(texts)
    places = defaultdict(list)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        assert r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["grown_shard"] is None and r["map_version"] == 1
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_documents(docs, rows):
    got = sharding.sharded(docs).collect()
    check(got, [(d, r["text"]) for d, r in rows.items()])
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in got)


def test_edges(edges, empty, clashing, spark):
    check(sharding.sharded(edges).collect(), [(r["doc_id"], r["text"]) for r in edges.collect()])
    check(sharding.sharded(clashing).collect(), [(r["doc_id"], r["text"]) for r in clashing.collect()])
    assert sharding.sharded(empty).count() == 0
    check(sharding.sharded(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")).collect(), [(None, "a"), (None, "a"), (1, None)])


def test_rows_without_an_id_are_spread(spark):
    df = spark.range(2400).selectExpr("cast(null as bigint) AS doc_id", "repeat('a', 50) AS text")
    got = sharding.sharded(df).collect()
    check(got, [(None, "a" * 50)] * 2400)
    load = Counter(r["shard"] for r in got)
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 3


def test_a_stored_map_is_used_again(docs, spark):
    path = scratch_path(spark, "map")
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(docs, map_path=path).collect()}
    again = sharding.sharded(docs, map_path=path).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in again} == first and len(again) == len(first)
    sharding.rebalance(spark, path, sharding.slot_sums(sharding.sized(docs)), 12)
    edited = sharding.sharded(docs, map_path=path).collect()
    assert {r["map_version"] for r in edited} == {2} and {r["shard"] for r in edited} == set(range(12)) and len(edited) == len(first)
    assert spark.read.parquet(path).groupBy("map_version").count().where(f"count != {sharding.SLOTS}").count() == 0


def greedy(sizes, shards):
    """The first map, told plainly."""
    load, out = [0] * shards, {}
    for s in sorted(range(sharding.SLOTS), key=lambda s: (-sizes.get(s, 0), s)):
        at = min(range(shards), key=lambda k: (load[k], k))
        load[at] += sizes.get(s, 0)
        out[s] = at
    return out


def test_the_first_map_is_greedy(docs):
    sums = sharding.slot_sums(sharding.sized(docs))
    got = {r["virtual_slot"]: r["shard"] for r in sharding.first_map(sums).collect()}
    assert got == greedy({r["virtual_slot"]: r["bytes"] for r in sums.collect()}, 24)


def test_rebalancing_edits_the_map(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('a', cast(id % 90 as int)) AS text")
    path = scratch_path(spark, "map")
    sums = sharding.slot_sums(sharding.sized(docs))
    sharding.store_map(sharding.first_map(sums), path, 1)
    first = {r["virtual_slot"]: r["shard"] for r in sharding.latest_map(spark, path).collect()}
    assert set(first) == set(range(sharding.SLOTS))
    size = {r["virtual_slot"]: r["bytes"] for r in sums.collect()}
    new = sharding.rebalance(spark, path, sums, 25)
    second = {r["virtual_slot"]: r["shard"] for r in new.collect()}
    assert {r["map_version"] for r in new.collect()} == {2} and set(second) == set(first)
    total = sum(size.values())
    moved = sum(size.get(s, 0) for s in first if first[s] != second[s])
    load = Counter()
    for s, b in size.items():
        load[second[s]] += b
    assert moved < 0.06 * total and max(load.values()) < 1.02 * total / 25
    same = sharding.rebalance(spark, path, sums, 25, slack=1.0)
    assert {r["virtual_slot"]: r["shard"] for r in same.collect()} == second and same.head()["map_version"] == 3
    fewer = {r["shard"] for r in sharding.rebalance(spark, path, sums, 20).collect()}
    assert fewer == set(range(20))
