import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenloom.llm import common, near_dup
from tokenloom.llm.graph import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    inverted, root = defaultdict(list), {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(sets):
        shared = Counter(e for k in sets[d] for e in inverted[k])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for k in sets[d]:
            inverted[k].append(d)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in texts}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()}


def test_equals_brute_force(docs, rows):
    assert result(docs) == brute({d: r["text"] for d, r in rows.items()})


@pytest.fixture(scope="module")
def planted(spark):
    """A large group of near copies around a base, chains, copies, and documents that share one long passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage, texts = [word() for _ in range(120)], [word() for _ in range(60)], []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for _ in range(30):
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(rng.randint(8, 60))] + passage) for _ in range(150)]
    texts += ["same text for all of us in this group"] * 40 + ["Same TEXT for all of us in this group"] * 3
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_planted_groups(spark, planted):
    df = spark.createDataFrame(list(planted.items()), "doc_id long, text string").repartition(5)
    assert result(df) == brute(planted)


def test_small_blocks_lose_nothing(spark, planted, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    df = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    assert result(df) == brute(planted)


def test_keys_of_near_signatures_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.integers(0, 1 << 16, size=(1, near_dup.SYMBOLS)).astype(np.uint16)
        y = x.copy()
        places = rng.choice(near_dup.INDEXED, size=near_dup.RADIUS, replace=False)
        y[0, places] ^= 1
        assert set(near_dup.chunk_keys(x)[0]) & set(near_dup.chunk_keys(y)[0])


def test_second_bound_loses_less_than_the_first():
    tail = lambda n, most: sum(math.comb(n, k) * 0.25**k * 0.75 ** (n - k) for k in range(most + 1, n + 1))
    assert tail(near_dup.SYMBOLS, near_dup.RADIUS_ALL) < tail(near_dup.INDEXED, near_dup.RADIUS) / 5


def test_edges(edges, unique, empty, clashing):
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert result(edges) == brute(texts) == result(clashing)
    assert near_dup.near_duplicates(edges).count() == edges.count()
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.deduplicated(edges)
    want = {d for d, (_, _, k) in brute(texts).items() if k}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == edges.columns
    assert near_dup.deduplicated(clashing).columns == clashing.columns


def test_null_and_repeated_ids(spark):
    t = "alpha beta gamma delta epsilon zeta"
    df = spark.createDataFrame([(None, t), (5, t), (5, "other words entirely in this row here"), (7, t + " eta theta iota kappa"), (None, None)], "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] == 5} == {5}
    assert {r["kept"] for r in got if r["doc_id"] == 7} == {True}


def test_groups_through_rows_without_id(spark):
    """A chain 1 - (no id) - 2, and a group that has no id at all."""
    w = [f"w{i}" for i in range(104)]
    a, between, b = (" ".join(w[i : i + 90]) for i in (0, 7, 14))
    other = [f"v{i}" for i in range(60)]
    rows = [(1, a), (None, between), (2, b), (None, " ".join(other)), (None, " ".join(other)), (None, " ".join([*other, "end"])), (None, None), (None, "")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got if r["component_id"]) == [(0, 1, False), (1, 1, True), (2, 1, False)]
    rest = [r for r in got if not r["component_id"]]
    assert len(rest) == 5 and [r["kept"] for r in rest if not r["n_shingles"]] == [True, True]
    assert sorted(r["kept"] for r in rest if r["n_shingles"]) == [False, False, True]


def test_repeated_ids_of_different_texts(spark):
    """Of one doc_id, a copy of another document goes and the unlinked text stays; rows without id go by their text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a, 0), (5, a + " end", 1), (5, b, 2), (5, b, 3), (None, a, 4), (None, c, 5), (None, c + " end", 6), (None, c, 7), (None, "", 8), (None, None, 9), (6, None, 10), (6, "", 11), (7, "x y", 12)]
    kept = near_dup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, node long"))
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted((d or 0, (t or "")[:1]) for d, t, _ in got) == [(0, ""), (0, ""), (0, "c"), (3, "a"), (5, "b"), (6, ""), (7, "x")]


def test_many_copies_share_no_task(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    texts = {i: "one text that has very many copies here" if i % 2 else "" if i % 3 == 0 else f"text {i} of its own words {i * 7} and {i * 13}" for i in range(3000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(16)
    shared = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = near_dup.near_duplicates(df)
        got, copies = result(df), out.rdd.mapPartitions(lambda p: [sum(r["doc_id"] % 2 for r in p)]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", shared[0])
        spark.conf.set("spark.sql.shuffle.partitions", shared[1])
    assert got == brute(texts) and sum(copies) == 1500 and max(copies) < 800


def test_lookups_of_hot_and_cold_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(i, 0 if i < 60 else i % 20 if i < 95 else None) for i in range(100)], "id int, k int")
    one = rows.where("k IS NOT NULL").groupBy("k").count().selectExpr("k", "k * 10 AS v", "count AS n")
    got = common.looked_up(rows, one, "k", "n", 100)
    assert sorted(map(tuple, got.select("id", "v").collect())) == [(r["id"], r["k"] * 10) for r in rows.where("k IS NOT NULL").orderBy("id").collect()]
    assert got.columns == ["k", "id", "v"]


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (50, 20), (200, 180), (60, 400)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)]
        root = {}
        for a, b in links:
            root.setdefault(a, a), root.setdefault(b, b)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        touched = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: find(x) for x in touched}


def test_crossing_rows_are_linear_beside_one_outlier(spark):
    """A bucket of one large component and one class outside it costs a row a class and one a block; all meet."""
    n = 5 * near_dup.BLOCK
    own = spark.range(n + 1).selectExpr("7L AS key", "id AS node", f"if(id = {n}, {n}L, 0L) AS comp")
    got = near_dup._crossing(own).collect()
    assert len(got) == n + 5
    blocks = defaultdict(lambda: ([], []))
    for r in got:
        blocks[r["block"]][r["side"] - 1].append(r["node"])
    assert all(a == [n] for a, _ in blocks.values()) and sorted(x for _, b in blocks.values() for x in b) == list(range(n))


def test_crossing_lets_all_components_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = random.Random(8)
    comp = {i: rng.choice([0, 0, 0, 1, 2, 3, 4]) for i in range(40)}
    own = spark.createDataFrame([(5, i, c) for i, c in comp.items()] + [(6, 100 + i, 1) for i in range(5)], "key long, node long, comp long")
    blocks = defaultdict(list)
    for r in near_dup._crossing(own).collect():
        blocks[r["block"]].append((r["node"], r["side"]))
    met = Counter()
    for b in blocks.values():
        for i, (x, s) in enumerate(b):
            for y, t in b[i + 1 :]:
                if (s, t) in ((0, 0), (1, 2), (2, 1)) and comp[x] != comp[y]:
                    met[min(x, y), max(x, y)] += 1
    assert met == Counter({(x, y): 1 for x in comp for y in comp if x < y and comp[x] != comp[y]})
