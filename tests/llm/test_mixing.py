import hashlib
import math
from collections import Counter

from tests import compare
from tokenloom.llm import mixing


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def poisson(u, rate):
    n, p = 0, math.exp(-rate)
    upto = p
    while upto <= u:
        n += 1
        p *= rate / n
        upto += p
    return n


def test_equals_oracle(docs, sf_dir):
    got = compare.rows(mixing.mixture(docs).toPandas())
    assert got == compare.rows(compare.connect(sf_dir).sql(mixing.oracle()).df())


def test_counts_are_inverted_poisson(docs, rows):
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixture(docs).collect())
    assert all(got[d] == poisson(uniform(mixing.SEED, d, 0), rate[r["source"]]) for d, r in rows.items())


def test_targets_are_met_on_average(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('a', 50) AS text", "if(id % 3 = 0, 'x', if(id % 3 = 1, 'y', 'z')) AS source")
    got = Counter(r["source"] for r in mixing.mixture(df, {"x": 3.0, "y": 1.0}).collect())
    assert set(got) == {"x", "y"} and abs(got["x"] - 4500) < 300 and abs(got["y"] - 1500) < 170


def test_large_rates_are_sums_of_parts(spark):
    df = spark.createDataFrame([(i, "a", "small") for i in range(20)] + [(100 + i, "b" * 4000, "large") for i in range(20)], "doc_id long, text string, source string")
    got = Counter(r["doc_id"] for r in mixing.mixture(df, {"small": 1.0, "large": 1.0}).collect())
    rate = {r["source"]: r["rate"] for r in mixing.rates(df, {"small": 1.0, "large": 1.0}).collect()}["small"]
    parts = math.ceil(rate / mixing.STEP)
    assert rate > 1000 and all(got[d] == sum(poisson(uniform(mixing.SEED, d, i), rate / parts) for i in range(parts)) for d in range(20))


def test_order_is_global(docs):
    keys = [r["shuffle_key"] for r in mixing.mixture(docs).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_edges(edges, empty, clashing, unique):
    out = mixing.replicated(edges)
    assert out.columns == edges.columns
    assert mixing.replicated(empty).count() == 0 and mixing.mixture(empty).count() == 0
    one = Counter(r["doc_id"] for r in mixing.replicated(unique).collect())
    assert Counter(r["doc_id"] for r in mixing.replicated(clashing).collect()) == one
    assert mixing.replicated(clashing).columns == clashing.columns
    blank = edges.where("doc_id IN (4, 5)").selectExpr("doc_id", "'' AS text", "source")
    assert {r["rate"] for r in mixing.rates(blank).collect()} == {1.0}


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    df = spark.range(2000).selectExpr("cast(null as bigint) AS doc_id", "concat('text ', id) AS text", "'a' AS source")
    got = Counter(r["text"] for r in mixing.replicated(df).collect())
    assert all(n == poisson(uniform(mixing.SEED, "text:" + hashlib.md5(t.encode()).hexdigest(), 0), 1.0) for t, n in got.items())
    assert 1100 < len(got) < 1430 and abs(sum(got.values()) - 2000) < 200
    keys = {r["shuffle_key"] for r in mixing.mixture(df).collect()}
    assert len(keys) == sum(got.values())


def test_equal_texts_without_an_id_are_drawn_one_by_one(spark):
    df = spark.range(3000).selectExpr("cast(null as bigint) AS doc_id", "if(id % 3 < 2, 'same', null) AS text", "if(id % 2 = 0, 'a', null) AS source", "map('k', id) AS extra").repartition(16)
    out = mixing.replicated(df)
    got = Counter(r["text"] for r in out.collect())
    assert out.columns == df.columns and abs(got["same"] - 2000) < 300 and abs(got[None] - 1000) < 200
    names = mixing.named(df).select("_tl_name", "source").collect()
    want = {f"text:{hashlib.md5(t).hexdigest()}" + (f":{i}" if i else "") for t, n in ((b"same", 2000), (b"", 1000)) for i in range(n)}
    assert {r["_tl_name"] for r in names} == want and len(names) == 3000
    sizes = out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(sizes) < sum(sizes) / 2


def test_oracle_numbers_rows_without_an_id_alike(spark, tmp_path):
    import duckdb

    df = spark.range(300).selectExpr("if(id % 5 = 0, id, null) AS doc_id", "if(id % 3 = 0, null, concat('t', id % 7)) AS text", "if(id % 4 = 0, null, concat('s', id % 2)) AS source")
    df.coalesce(3).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    out = mixing.mixture(df)
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({mixing.oracle()})").fetchall()  # no pandas: doc_id and bytes have nulls
    assert Counter(map(tuple, out.collect())) == Counter(want)
