"""Queries of the tensor, attention and Transformer operators over embeddings.

Weights are integer formulas that every engine evaluates alike; sequences are 8 vectors in a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..functions import tensor as T
from ..operators import attention as A
from ..operators import tensor as R
from .sqlgen import weight

D, SEQ, HEADS, HEAD, FF, VOCAB, LAYERS = 64, 8, 4, 16, 128, 50, 2
THETA = 10000.0


def rounded(c: str, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def cell(seed: int = 0):
    return lambda i, j: (((i * 31 + j * 17 + seed) % 101) - 50) / F.lit(500.0)


def weights(rows: int, columns: int, seed: int = 0) -> np.ndarray:
    i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return ((i * 31 + j * 17 + seed) % 101 - 50) / 500.0


def gain(n: int = D) -> np.ndarray:
    return 1.0 + (np.arange(n) % 5) / 10.0


GAIN_SQL = "(1 + (k % 5) / CAST(10 AS DOUBLE))"


def vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", T.vec("embedding").alias("x"))


def with_params(df: DataFrame, **named) -> DataFrame:
    """df with parameter columns from a single broadcast row, whose size is that of the parameters."""
    one = df.sparkSession.range(1).select(*[c.alias(n) for n, c in named.items()])
    return df.crossJoin(F.broadcast(one))


def out(df: DataFrame, array, *keys: str) -> DataFrame:
    return R.long(df, array, *keys).select(*keys, "k", rounded("v").alias("v"))


X = "x AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def lin(name: str, src: str, rows: int, seed: int, keys: str = "vec_id") -> str:
    return f"{name} AS MATERIALIZED (SELECT {keys}, j AS k, sum(v * ({weight('j', 'k', seed)})) AS v FROM {src}, range({rows}) t(j) GROUP BY {keys}, j)"


def rms(name: str, src: str, keys: str = "vec_id") -> str:
    return f"{name} AS MATERIALIZED (SELECT {keys}, k, v / sqrt(avg(v * v) OVER (PARTITION BY {keys}) + 1e-5) * {GAIN_SQL} AS v FROM {src})"


def done(ctes: list[str], last: str, keys: str = "vec_id") -> str:
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {keys}, CAST(k AS INT) AS k, round(v, 6) + 0.0 AS v FROM {last}"


# ---- row-wise layers


def linear(spark, d):
    df = with_params(vectors(spark, d), w=T.matrix(16, D, cell()))
    return out(df, T.linear(F.col("x"), F.col("w")), "vec_id")


def matmul(spark, d):
    a = R.long(vectors(spark, d), "x", "vec_id").select(F.col("vec_id").alias("i"), "k", "v")
    b = spark.range(D).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j")).withColumn("v", cell()(F.col("j"), F.col("k")))
    return R.matmul(a, F.broadcast(b)).select(F.col("i").alias("vec_id"), F.col("j").alias("k"), rounded("v").alias("v"))


def embedding_lookup(spark, d):
    ids = vectors(spark, d).select("vec_id", ((F.col("vec_id") * 7) % VOCAB).cast("int").alias("token_id"))
    table = spark.range(VOCAB).select(F.col("id").cast("int").alias("token_id"), T.matrix(VOCAB, 8, cell(3)).alias("m")).select("token_id", F.get("m", F.col("token_id")).alias("e"))
    return out(R.embedding_lookup(ids, F.broadcast(table)), "e", "vec_id")


def rmsnorm(spark, d):
    g = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda k: F.lit(1.0) + (k % 5) / F.lit(10.0))
    return out(with_params(vectors(spark, d), g=g), T.rms_norm(F.col("x"), F.col("g")), "vec_id")


def silu(spark, d):
    return out(vectors(spark, d), T.silu(F.col("x")), "vec_id")


def residual_add(spark, d):
    return out(vectors(spark, d), T.add(F.col("x"), T.silu(F.col("x"))), "vec_id")


FFN = {"w1": weights(FF, D, 1), "w2": weights(D, FF, 2), "w3": weights(FF, D, 3)}


def _ffn(kind):
    return lambda spark, d: out(R.swiglu_rows(vectors(spark, d), FFN, "vec_id", kind), "y", "vec_id")


def swiglu_columns(spark, d):
    df = with_params(vectors(spark, d), w1=T.matrix(8, D, cell(1)), w2=T.matrix(4, 8, cell(2)), w3=T.matrix(8, D, cell(3)))
    return out(df, T.swiglu(F.col("x"), F.col("w1"), F.col("w2"), F.col("w3")), "vec_id")


def swiglu_sql(width: int, rows: int) -> str:
    gate = "u AS MATERIALIZED (SELECT a.vec_id, a.k, a.v / (1 + exp(-a.v)) * c.v AS v FROM h1 a JOIN h3 c USING (vec_id, k))"
    return done([X, lin("h1", "x", width, 1), lin("h3", "x", width, 3), gate, lin("y", "u", rows, 2)], "y")


SILU_FFN_SQL = done([X, lin("h1", "x", FF, 1), "u AS MATERIALIZED (SELECT vec_id, k, v / (1 + exp(-v)) AS v FROM h1)", lin("y", "u", D, 2)], "y")


def _rope(halves):
    return lambda spark, d: out(vectors(spark, d), T.rope(F.col("x"), F.col("vec_id") % 100, THETA, halves), "vec_id")


def rope_sql(halves: bool) -> str:
    angle = f"(a.vec_id % 100) * pow({THETA}, -(a.k - a.k % 2) / CAST({D} AS DOUBLE))"
    place = f"(CASE WHEN a.k % 2 = 0 THEN a.k // 2 ELSE {D // 2} + a.k // 2 END)" if halves else "a.k"
    turn = f"r AS (SELECT a.vec_id, {place} AS k, CASE WHEN a.k % 2 = 0 THEN a.v * cos({angle}) - o.v * sin({angle}) ELSE o.v * sin({angle}) + a.v * cos({angle}) END AS v FROM x a JOIN x o ON a.vec_id = o.vec_id AND o.k = xor(a.k, 1))"
    return done([X, turn], "r")


def softmax(spark, d):
    return out(vectors(spark, d), T.softmax(F.col("x")), "vec_id")


def softmax_over_rows(spark, d):
    rows = R.long(vectors(spark, d), "x", "vec_id").withColumn("g", F.floor(F.col("vec_id") / 10))
    return R.softmax_over(rows, ["g", "k"], "v").select("vec_id", "k", rounded("p").alias("v"))


def log_softmax(spark, d):
    return out(vectors(spark, d), T.log_softmax(F.col("x")), "vec_id")


def logsumexp(spark, d):
    return vectors(spark, d).select("vec_id", F.round(T.log_sum_exp(F.col("x")), 6).alias("lse"))


def cross_entropy(spark, d):
    df = vectors(spark, d).withColumn("target", (F.col("vec_id") % D).cast("int"))
    return R.cross_entropy(df, "x", "target").select(F.round("loss", 6).alias("loss"), "n")


def cross_entropy_large(spark, d):
    df = vectors(spark, d).select(T.scale(F.col("x"), 1000.0).alias("x"), (F.col("vec_id") % D).cast("int").alias("target"))
    return R.cross_entropy(df, "x", "target").select(F.round("loss", 4).alias("loss"), "n")


_LSE = "l AS (SELECT vec_id, max(m) + ln(sum(exp(v - m))) AS lse FROM (SELECT vec_id, k, v, max(v) OVER (PARTITION BY vec_id) AS m FROM x) GROUP BY vec_id)"


def _ce_sql(by: str, digits: int) -> str:
    return f"WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) * {by} AS v FROM embeddings), {_LSE} SELECT round(avg(lse - v), {digits}) AS loss, count(*) AS n FROM l JOIN x ON x.vec_id = l.vec_id AND x.k = x.vec_id % {D}"


# ---- attention; long rows (b, h, p, k, v)


def heads(spark, d, seed: int | None = None) -> DataFrame:
    """Sequences of 8 vectors, 4 heads of 16; seed: a fixed signed scaling of features, to tell q, k and v apart."""
    x = F.col("x")
    if seed is not None:
        x = F.transform(x, lambda v, k: v * cell(seed)(k, F.lit(1)) * 10)
    part = F.transform(F.sequence(F.lit(0), F.lit(HEADS - 1)), lambda h: F.struct(h.alias("h"), F.slice(F.col("y"), h * HEAD + 1, F.lit(HEAD)).alias("x")))
    rows = vectors(spark, d).select(F.floor(F.col("vec_id") / SEQ).alias("b"), (F.col("vec_id") % SEQ).alias("p"), x.alias("y"))
    return rows.select("b", "p", F.explode(part).alias("s")).select("b", "s.h", "p", "s.x")


def heads_sql(name: str, seed: int | None) -> str:
    v = "v" if seed is None else f"v * ({weight('k', '1', seed)}) * 10"
    return f"{name} AS MATERIALIZED (SELECT vec_id // {SEQ} AS b, k // {HEAD} AS h, vec_id % {SEQ} AS p, k % {HEAD} AS k, {v} AS v FROM x)"


def scores_sql(where: str = "", score: str = "") -> str:
    dot = f"sum(q.v * c.v) / sqrt(CAST({HEAD} AS DOUBLE))"
    value = score.format(dot=dot) if score else dot
    return f"sc AS MATERIALIZED (SELECT q.b, q.h, q.p, c.p AS s, {value} AS score FROM q JOIN c ON q.b = c.b AND q.h = c.h AND q.k = c.k {where} GROUP BY q.b, q.h, q.p, c.p)"


_SOFT = "pr AS MATERIALIZED (SELECT b, h, p, s, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY b, h, p) AS w FROM (SELECT *, max(score) OVER (PARTITION BY b, h, p) AS m FROM sc))"
_OUT = "o AS MATERIALIZED (SELECT pr.b, pr.h, pr.p, u.k, sum(w * u.v) AS v FROM pr JOIN u ON pr.b = u.b AND pr.h = u.h AND pr.s = u.p GROUP BY pr.b, pr.h, pr.p, u.k)"
QKV = [X, heads_sql("q", 1), heads_sql("c", 2), heads_sql("u", 3)]
_ROUND = "\nSELECT b, h, p, k, round(v, 6) + 0.0 AS v FROM o"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("b").cast("bigint").alias("b"), F.col("h").cast("bigint").alias("h"), F.col("p").cast("bigint").alias("p"), F.col("k").cast("bigint").alias("k"), rounded("v").alias("v"))


def qkv(spark, d):
    return heads(spark, d, 1), heads(spark, d, 2), heads(spark, d, 3)


def sdpa(spark, d):
    q, k, v = qkv(spark, d)
    return _rounded(A.attend(A.scores(q, k), v))


def sdpa_causal(spark, d):
    q, k, v = qkv(spark, d)
    return _rounded(A.attend(A.scores(q, k, causal=True), v))


def sdpa_mask(spark, d):
    q, k, v = qkv(spark, d)
    mask = spark.range(SEQ * SEQ).select(F.floor(F.col("id") / SEQ).alias("p"), (F.col("id") % SEQ).alias("s")).where("(p * 3 + s * 5) % 7 < 4 AND p != 2")  # position 2 attends to nothing
    return _rounded(A.attend(A.scores(q, k, mask=mask), v))


def sdpa_tiled(spark, d):
    q, k, v = qkv(spark, d)
    return _rounded(A.tiled(q, k, v, tile=3, causal=True)[0])


def attention_lse(spark, d):
    q, k, v = qkv(spark, d)
    lse = A.tiled(q, k, v, tile=3)[1]
    return lse.select(*[F.col(c).cast("bigint").alias(c) for c in ("b", "h", "p")], F.round("lse", 6).alias("lse"))


def sdpa_backward(spark, d):
    q, k, v = qkv(spark, d)
    g = A.backward(q, k, v, heads(spark, d, 4), causal=True)
    return g.select("which", *[F.col(c).cast("bigint").alias(c) for c in ("b", "h", "p", "k")], rounded("v").alias("v"))


def _backward_tiled(causal: bool):
    def run(spark, d):
        q, k, v = qkv(spark, d)
        g = A.backward_tiled(q, k, v, heads(spark, d, 4), tile=3, causal=causal)
        return g.select("which", *[F.col(c).cast("bigint").alias(c) for c in ("b", "h", "p", "k")], rounded("v").alias("v"))

    return run


_BACK = [
    *QKV, heads_sql("g", 4), scores_sql("AND c.p <= q.p"), _SOFT, _OUT,
    "dl AS (SELECT b, h, p, sum(g.v * o.v) AS delta FROM g JOIN o USING (b, h, p, k) GROUP BY b, h, p)",
    "dp AS (SELECT pr.b, pr.h, pr.p, pr.s, any_value(pr.w) AS w, sum(g.v * u.v) AS dp FROM pr JOIN g ON pr.b = g.b AND pr.h = g.h AND pr.p = g.p JOIN u ON pr.b = u.b AND pr.h = u.h AND pr.s = u.p AND g.k = u.k GROUP BY pr.b, pr.h, pr.p, pr.s)",
    f"ds AS MATERIALIZED (SELECT b, h, p, s, w * (dp - delta) / sqrt(CAST({HEAD} AS DOUBLE)) AS ds FROM dp JOIN dl USING (b, h, p))",
    "gr AS (SELECT 'dq' AS which, ds.b, ds.h, ds.p, c.k, sum(ds * c.v) AS v FROM ds JOIN c ON ds.b = c.b AND ds.h = c.h AND ds.s = c.p GROUP BY ALL UNION ALL SELECT 'dk', ds.b, ds.h, ds.s, q.k, sum(ds * q.v) FROM ds JOIN q ON ds.b = q.b AND ds.h = q.h AND ds.p = q.p GROUP BY ALL UNION ALL SELECT 'dv', pr.b, pr.h, pr.s, g.k, sum(w * g.v) FROM pr JOIN g ON pr.b = g.b AND pr.h = g.h AND pr.p = g.p GROUP BY ALL)",
]
BACKWARD_SQL = "WITH " + ",\n".join(_BACK) + "\nSELECT which, b, h, p, k, round(v, 6) + 0.0 AS v FROM gr"


# ---- whole layers on sequences


def layer(seed: int) -> dict[str, np.ndarray]:
    names = {"q": D, "k": D, "v": D, "o": D, "w1": FF, "w3": FF, "w2": D}
    w = {n: weights(r, FF if n == "w2" else D, seed + i) for i, (n, r) in enumerate(names.items())}
    return {**w, "ln1": gain(), "ln2": gain()}


def sequences(spark, d):
    return vectors(spark, d).select(F.floor(F.col("vec_id") / SEQ).alias("b"), (F.col("vec_id") % SEQ).alias("p"), "x")


def _seq_out(df):
    return df.select("b", "p", "k", rounded("v").alias("v"))


def mha_rope(spark, d):
    w = layer(10)
    return _seq_out(R.over_sequences(sequences(spark, d), lambda x: dense.multi_head(x, w, HEADS, THETA), D))


def mha(spark, d):
    w = layer(10)
    return _seq_out(R.over_sequences(sequences(spark, d), lambda x: dense.multi_head(x, w, HEADS, None), D))


def _block(norm, ffn="swiglu"):
    def run(spark, d):
        w = layer(10)
        return _seq_out(R.over_sequences(sequences(spark, d), lambda x: dense.block(x, w, HEADS, THETA, norm, ffn), D))

    return run


def lm_weights() -> dict:
    return {"embedding": weights(VOCAB, D, 5), "layers": [layer(10 + 20 * i) for i in range(LAYERS)], "ln_final": gain(), "head": weights(VOCAB, D, 6)}


def lm_logits(spark, d, w: dict, heads: int, theta: float):
    ids = vectors(spark, d).select(F.floor(F.col("vec_id") / SEQ).alias("b"), (F.col("vec_id") % SEQ).alias("p"), F.array((F.col("vec_id") * 7) % VOCAB).alias("x"))
    return _seq_out(R.over_sequences(ids, lambda x: dense.language_model(x[:, 0].astype(int), w, heads, theta), VOCAB))


def transformer_lm(spark, d):
    return lm_logits(spark, d, lm_weights(), HEADS, THETA)


S = f"x AS MATERIALIZED (SELECT vec_id // {SEQ} AS b, vec_id % {SEQ} AS p, k, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"


def mha_ctes(src: str, n: str, seed: int, rotate: bool = True) -> list[str]:
    def head(name, of):
        angle = f"a.p * pow({THETA}, -(a.k % {HEAD} - a.k % 2) / CAST({HEAD} AS DOUBLE))"
        if not rotate or of.startswith("v"):
            return f"{name} AS MATERIALIZED (SELECT b, p, k // {HEAD} AS h, k, v FROM {of})"
        return f"{name} AS MATERIALIZED (SELECT a.b, a.p, a.k // {HEAD} AS h, a.k, CASE WHEN a.k % 2 = 0 THEN a.v * cos({angle}) - o.v * sin({angle}) ELSE o.v * sin({angle}) + a.v * cos({angle}) END AS v FROM {of} a JOIN {of} o ON a.b = o.b AND a.p = o.p AND o.k = xor(a.k, 1))"

    return [
        lin(f"q{n}", src, D, seed, "b, p"), lin(f"k{n}", src, D, seed + 1, "b, p"), lin(f"v{n}", src, D, seed + 2, "b, p"),
        head(f"qr{n}", f"q{n}"), head(f"kr{n}", f"k{n}"), head(f"vr{n}", f"v{n}"),
        f"sc{n} AS MATERIALIZED (SELECT q.b, q.p, c.p AS s, q.h, sum(q.v * c.v) / sqrt(CAST({HEAD} AS DOUBLE)) AS score FROM qr{n} q JOIN kr{n} c ON q.b = c.b AND q.k = c.k AND c.p <= q.p GROUP BY ALL)",
        f"pr{n} AS MATERIALIZED (SELECT b, p, s, h, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY b, p, h) AS w FROM (SELECT *, max(score) OVER (PARTITION BY b, p, h) AS m FROM sc{n}))",
        f"at{n} AS MATERIALIZED (SELECT pr.b, pr.p, u.k, sum(w * u.v) AS v FROM pr{n} pr JOIN vr{n} u ON pr.b = u.b AND pr.h = u.h AND pr.s = u.p GROUP BY ALL)",
        lin(f"mh{n}", f"at{n}", D, seed + 3, "b, p"),
    ]


def ffn_ctes(src: str, n: str, seed: int, kind: str = "swiglu") -> list[str]:
    gate = f"a.v / (1 + exp(-a.v)) * c.v AS v FROM h1{n} a JOIN h3{n} c USING (b, p, k)" if kind == "swiglu" else f"a.v / (1 + exp(-a.v)) AS v FROM h1{n} a"
    return [lin(f"h1{n}", src, FF, seed + 4, "b, p"), lin(f"h3{n}", src, FF, seed + 5, "b, p"), f"u{n} AS MATERIALIZED (SELECT a.b, a.p, a.k, {gate})", lin(f"ff{n}", f"u{n}", D, seed + 6, "b, p")]


def plus(name: str, a: str, b: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT b, p, k, {a}.v + {b}.v AS v FROM {a} JOIN {b} USING (b, p, k))"


def block_ctes(src: str, n: str, seed: int, norm: str = "pre", ffn: str = "swiglu") -> list[str]:
    if norm == "pre":
        return [rms(f"n1{n}", src, "b, p"), *mha_ctes(f"n1{n}", n, seed), plus(f"r1{n}", src, f"mh{n}"), rms(f"n2{n}", f"r1{n}", "b, p"), *ffn_ctes(f"n2{n}", n, seed, ffn), plus(f"y{n}", f"r1{n}", f"ff{n}")]
    if norm == "post":
        return [*mha_ctes(src, n, seed), plus(f"r1{n}", src, f"mh{n}"), rms(f"n1{n}", f"r1{n}", "b, p"), *ffn_ctes(f"n1{n}", n, seed, ffn), plus(f"r2{n}", f"n1{n}", f"ff{n}"), rms(f"y{n}", f"r2{n}", "b, p")]
    return [*mha_ctes(src, n, seed), plus(f"r1{n}", src, f"mh{n}"), *ffn_ctes(f"r1{n}", n, seed, ffn), plus(f"y{n}", f"r1{n}", f"ff{n}")]


def seq_sql(ctes: list[str], last: str) -> str:
    return "WITH " + ",\n".join(ctes) + f"\nSELECT b, p, k, round(v, 6) + 0.0 AS v FROM {last}"


LM_SQL = seq_sql(
    [
        f"x AS MATERIALIZED (SELECT vec_id // {SEQ} AS b, vec_id % {SEQ} AS p, k, {weight(f'(vec_id * 7) % {VOCAB}', 'k', 5)} AS v FROM embeddings, range({D}) t(k))",
        *block_ctes("x", "0", 10), *block_ctes("y0", "1", 30), rms("fin", "y1", "b, p"), lin("lg", "fin", VOCAB, 6, "b, p"),
    ],
    "lg",
)


def linear_half(spark, d):
    df = with_params(vectors(spark, d), w=T.matrix(16, D, cell()))
    return out(df, T.linear_half(F.col("x"), F.col("w")), "vec_id")


def half_sql(v: str) -> str:
    """v rounded to half precision."""
    quantum = f"pow(2::DOUBLE, greatest(floor(log2(abs({v}))), -14) - 10)"
    return f"CASE WHEN {v} = 0 THEN {v} ELSE round_even({v} / {quantum}, 0) * {quantum} END"


_HALF_W = f"hw AS MATERIALIZED (SELECT i, j, {half_sql('v')} AS v FROM (SELECT i, j, {weight('i', 'j')} AS v FROM range(16) a(i), range({D}) b(j)))"
LINEAR_HALF_SQL = done([X, _HALF_W, f"hx AS MATERIALIZED (SELECT vec_id, k, {half_sql('v')} AS v FROM x)", "y AS (SELECT vec_id, i AS k, sum(hx.v * hw.v) AS v FROM hx JOIN hw ON hx.k = hw.j GROUP BY vec_id, i)"], "y")


def config_capture(spark, d):
    """The arguments of a model with a row of its embedding for every vector, written and read back."""
    from ..sources import vocab
    from ..sources.scratch import scratch_path

    path = scratch_path(spark, "config")
    size = vectors(spark, d).agg(F.count("*").cast("int").alias("vocab_size"), F.lit(SEQ).alias("context_length"), F.max(F.size("x")).alias("d_model"))
    size.select("*", F.lit(LAYERS).alias("num_layers"), F.lit(HEADS).alias("num_heads"), F.lit(FF).alias("d_ff"), F.lit(THETA).alias("rope_theta")).coalesce(1).write.json(path)
    return vocab.config(spark, path, vocab.CONFIG)


CONFIG_SQL = f"SELECT CAST(count(*) AS INT) AS vocab_size, {SEQ} AS context_length, CAST(max(len(embedding)) AS INT) AS d_model, {LAYERS} AS num_layers, {HEADS} AS num_heads, {FF} AS d_ff, CAST({THETA} AS DOUBLE) AS rope_theta FROM embeddings"


def parameters(spark) -> DataFrame:
    """name, i, j, v of all parameters of the test model."""
    w = lm_weights()
    shapes = [("embedding", VOCAB, D), ("head", VOCAB, D), ("ln_final", 1, D)]
    for n, lay in enumerate(w["layers"]):
        shapes += [(f"layers.{n}.{k}", *(m.shape if m.ndim == 2 else (1, len(m)))) for k, m in lay.items()]
    table = spark.createDataFrame([(n, int(r), int(c)) for n, r, c in shapes], "name string, r int, c int")
    return table.select("name", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("i"), "c").select("name", "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j")).withColumn("v", cell()(F.col("i"), F.col("j")))


def param_count(spark, d):
    """Of a model whose embedding has a row for every vector."""
    own = vectors(spark, d).select(F.lit("embedding").alias("name"), F.col("vec_id").cast("int").alias("i"), F.posexplode("x").alias("j", "v"))
    return R.param_count(parameters(spark).where("name != 'embedding'").unionByName(own))


_SHAPES = [("embedding", VOCAB * D), ("head", VOCAB * D), ("ln_final", D)] + [(f"layers.{n}.{k}", c) for n in range(LAYERS) for k, c in (("q", D * D), ("k", D * D), ("v", D * D), ("o", D * D), ("w1", FF * D), ("w3", FF * D), ("w2", FF * D), ("ln1", D), ("ln2", D))]
_FIXED = [(n, c) for n, c in _SHAPES if n != "embedding"]
PARAM_COUNT_SQL = "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({c} AS BIGINT))" for n, c in _FIXED) + f") t(name, n) UNION ALL SELECT 'embedding', count(*) * {D} FROM embeddings) SELECT * FROM t UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM t"

QUERIES = {
    "linear": linear, "matmul": matmul, "embedding_lookup": embedding_lookup, "rmsnorm": rmsnorm, "silu": silu, "residual_add": residual_add,
    "swiglu": _ffn("swiglu"), "swiglu_columns": swiglu_columns, "silu_ffn": _ffn("silu"), "rope": _rope(False), "rope_halves": _rope(True),
    "softmax": softmax, "softmax_over_rows": softmax_over_rows, "log_softmax": log_softmax, "logsumexp": logsumexp, "cross_entropy": cross_entropy, "cross_entropy_large": cross_entropy_large,
    "sdpa": sdpa, "sdpa_causal": sdpa_causal, "sdpa_mask": sdpa_mask, "sdpa_tiled": sdpa_tiled, "attention_lse": attention_lse, "sdpa_backward": sdpa_backward, "sdpa_backward_tiled": _backward_tiled(True), "sdpa_backward_tiled_full": _backward_tiled(False),
    "mha": mha, "mha_rope": mha_rope, "transformer_block": _block("pre"), "transformer_block_post": _block("post"), "transformer_block_none": _block("none", "silu"), "transformer_lm": transformer_lm, "param_count": param_count, "linear_half": linear_half, "config_capture": config_capture,
}
ORACLES = {
    "linear": done([X, lin("y", "x", 16, 0)], "y"),
    "matmul": done([X, lin("y", "x", 16, 0)], "y"),
    "embedding_lookup": f"SELECT vec_id, CAST(k AS INT) AS k, round({weight(f'(vec_id * 7) % {VOCAB}', 'k', 3)}, 6) AS v FROM embeddings, range(8) t(k)",
    "rmsnorm": done([X, rms("y", "x")], "y"),
    "silu": done([X], "(SELECT vec_id, k, v / (1 + exp(-v)) AS v FROM x)"),
    "residual_add": done([X], "(SELECT vec_id, k, v + v / (1 + exp(-v)) AS v FROM x)"),
    "swiglu": swiglu_sql(FF, D),
    "swiglu_columns": swiglu_sql(8, 4),
    "silu_ffn": SILU_FFN_SQL,
    "rope": rope_sql(False),
    "rope_halves": rope_sql(True),
    "softmax": done([X], "(SELECT vec_id, k, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS v FROM x)"),
    "softmax_over_rows": done([X], "(SELECT vec_id, k, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id // 10, k) AS v FROM x)"),
    "log_softmax": done([X], "(SELECT vec_id, k, v - ln(sum(exp(v)) OVER (PARTITION BY vec_id)) AS v FROM x)"),
    "logsumexp": f"WITH {X}, {_LSE} SELECT vec_id, round(lse, 6) AS lse FROM l",
    "cross_entropy": _ce_sql("1", 6),
    "cross_entropy_large": _ce_sql("1000", 4),
    "sdpa": "WITH " + ",\n".join([*QKV, scores_sql(), _SOFT, _OUT]) + _ROUND,
    "sdpa_causal": "WITH " + ",\n".join([*QKV, scores_sql("AND c.p <= q.p"), _SOFT, _OUT]) + _ROUND,
    "sdpa_mask": "WITH " + ",\n".join([*QKV, scores_sql("AND (q.p * 3 + c.p * 5) % 7 < 4 AND q.p <> 2"), _SOFT, _OUT]) + _ROUND,
    "sdpa_tiled": "WITH " + ",\n".join([*QKV, scores_sql("", "CASE WHEN c.p <= q.p THEN {dot} ELSE -1e6 END"), _SOFT, _OUT]) + _ROUND,
    "attention_lse": "WITH " + ",\n".join([*QKV[:3], scores_sql()]) + " SELECT b, h, p, round(m + ln(sum(exp(score - m))), 6) AS lse FROM (SELECT *, max(score) OVER (PARTITION BY b, h, p) AS m FROM sc) GROUP BY b, h, p, m",
    "sdpa_backward": BACKWARD_SQL,
    "sdpa_backward_tiled": BACKWARD_SQL,
    "sdpa_backward_tiled_full": BACKWARD_SQL.replace(scores_sql("AND c.p <= q.p"), scores_sql()),
    "mha": seq_sql([S, *mha_ctes("x", "0", 10, rotate=False)], "mh0"),
    "mha_rope": seq_sql([S, *mha_ctes("x", "0", 10)], "mh0"),
    "transformer_block": seq_sql([S, *block_ctes("x", "0", 10)], "y0"),
    "transformer_block_post": seq_sql([S, *block_ctes("x", "0", 10, "post")], "y0"),
    "transformer_block_none": seq_sql([S, *block_ctes("x", "0", 10, "none", "silu")], "y0"),
    "transformer_lm": LM_SQL,
    "linear_half": LINEAR_HALF_SQL,
    "param_count": PARAM_COUNT_SQL,
    "config_capture": CONFIG_SQL,
}
