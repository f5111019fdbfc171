"""Queries of the optimizer, sampling, distribution, checkpoint and verification operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tensor import half
from ..operators import optim, sampling, training, verify
from ..sources import state as S
from ..sources import vocab as V
from ..sources.scratch import scratch_path, written
from .sqlgen import weight
from .tensor_queries import _SHAPES, LM_SQL, SEQ, THETA, D, HEADS, VOCAB, block_ctes, cell, half_sql, lin, lm_logits, lm_weights, parameters, rms, rounded, vectors

ROWS = 8


def params(spark) -> DataFrame:
    return spark.range(ROWS).select(F.lit("w").alias("name"), F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(D - 1))).alias("j")).withColumn("v", cell()(F.col("i"), F.col("j")))


def rank_grads(spark, d) -> DataFrame:
    """rank, name, i, j, v, n: each of four ranks' sums over its vectors; row i is the vector's number modulo 8."""
    rows = vectors(spark, d).select((F.col("vec_id") % 4).cast("int").alias("rank"), (F.floor(F.col("vec_id") / 4) % ROWS).cast("int").alias("i"), F.posexplode("x").alias("j", "v"))
    return rows.groupBy("rank", "i", "j").agg(F.avg("v").alias("v")).select("rank", F.lit("w").alias("name"), "i", "j", "v")


def grads(spark, d) -> DataFrame:
    rows = vectors(spark, d).select((F.col("vec_id") % ROWS).cast("int").alias("i"), F.posexplode("x").alias("j", "v"))
    return rows.groupBy("i", "j").agg(F.avg("v").alias("v")).select(F.lit("w").alias("name"), "i", "j", "v").where("i != 7")  # row 7 has no gradient


X = "x AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
GRADS = f"{X}, g AS MATERIALIZED (SELECT 'w' AS name, CAST(vec_id % {ROWS} AS INT) AS i, CAST(k AS INT) AS j, avg(v) AS v FROM x WHERE vec_id % {ROWS} <> 7 GROUP BY ALL)"
P0 = f"p AS (SELECT 'w' AS name, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {weight('i', 'j')} AS v FROM range({ROWS}) a(i), range({D}) b(j))"


def table_params(spark, d) -> DataFrame:
    """name, i, j, v, label: the whole embeddings table as one parameter matrix, a row a vector."""
    return vectors(spark, d).select(F.lit("w").alias("name"), F.col("vec_id").cast("int").alias("i"), F.posexplode("x").alias("j", "v"), "label")


TABLE = f"{X}, p AS (SELECT 'w' AS name, CAST(vec_id AS INT) AS i, CAST(k AS INT) AS j, v, label FROM x JOIN embeddings USING (vec_id))"


def lr_cosine(spark, d):
    """The rate at the step of every vector."""
    return vectors(spark, d).select(F.col("vec_id").alias("step"), rounded_col(optim.cosine_lr(F.col("vec_id"), 1.0, 0.1, 100, 400), 9).alias("lr"))


def rounded_col(c, digits=6):
    return F.round(c, digits) + F.lit(0.0)


LR_SQL = "SELECT step, round(CASE WHEN step < 100 THEN step / CAST(100 AS DOUBLE) WHEN step <= 400 THEN 0.1 + 0.5 * (1 + cos(pi() * (step - 100) / 300)) * 0.9 ELSE 0.1 END, 9) + 0.0 AS lr FROM (SELECT vec_id AS step FROM embeddings)"


def grad_norm(spark, d):
    return optim.global_norm(grads(spark, d)).select(rounded_col(F.col("norm"), 9).alias("norm"))


def _clip(always):
    return lambda spark, d: optim.clip(grads(spark, d), 0.01, always).select(*optim.KEYS, rounded("v", 9).alias("v"))


def clip_unchanged(spark, d):
    return optim.clip(grads(spark, d), 1e9).select(*optim.KEYS, rounded("v", 9).alias("v"))


_CLIP = f"WITH {GRADS}, n AS (SELECT sqrt(sum(v * v)) AS norm FROM g) SELECT name, i, j, round(v * {{}}, 9) + 0.0 AS v FROM g, n"


def _state(df):
    return df.select(*optim.KEYS, rounded("v", 9).alias("v"), rounded("m", 9).alias("m"), rounded("s", 9).alias("s"))


def _steps(spark, d, n: int, eps_first: bool) -> DataFrame:
    st, g = optim.fresh(params(spark)), written(grads(spark, d), "grads")
    for t in range(1, n + 1):
        st = optim.adamw(st, g.withColumn("v", F.col("v") * F.lit(1.0 + 0.5 * t)), t, lr=0.1, eps=1e-3 if eps_first else 1e-8, decay=0.1, eps_first=eps_first)
    return st


def _adamw(n, eps_first=False):
    return lambda spark, d: _state(_steps(spark, d, n, eps_first))


def adamw_sql(n: int, eps_first: bool) -> str:
    ctes = [GRADS, P0, "s0 AS (SELECT p.*, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS s, g.v AS g FROM p LEFT JOIN g USING (name, i, j))"]
    for t in range(1, n + 1):
        f1, f2 = f"(1 - pow(CAST(0.9 AS DOUBLE), {t}))", f"(1 - pow(CAST(0.999 AS DOUBLE), {t}))"
        grad = f"(g * {1.0 + 0.5 * t})"
        new = f"SELECT name, i, j, v, g, CASE WHEN g IS NULL THEN m ELSE CAST(0.9 AS DOUBLE) * m + (1 - CAST(0.9 AS DOUBLE)) * {grad} END AS m, CASE WHEN g IS NULL THEN s ELSE CAST(0.999 AS DOUBLE) * s + (1 - CAST(0.999 AS DOUBLE)) * {grad} * {grad} END AS s FROM s{t - 1}"
        move = f"0.1 * sqrt({f2}) / {f1} * m / (sqrt(s) + 1e-3)" if eps_first else f"0.1 / {f1} * m / (sqrt(s / {f2}) + 1e-8)"
        ctes.append(f"s{t} AS MATERIALIZED (SELECT name, i, j, CASE WHEN g IS NULL THEN v ELSE v * (1 - CAST(0.01 AS DOUBLE)) - CAST({move} AS DOUBLE) END AS v, g, m, s FROM ({new}))")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT name, i, j, round(v, 9) + 0.0 AS v, round(m, 9) + 0.0 AS m, round(s, 9) + 0.0 AS s FROM s{n}"


def ddp_grad_avg(spark, d):
    return optim.averaged(rank_grads(spark, d)).select(*optim.KEYS, rounded("v").alias("v"))


_RANKS = f"{X}, r AS (SELECT vec_id % 4 AS rank, vec_id // 4 % {ROWS} AS i, k AS j, avg(v) AS v FROM x GROUP BY ALL), a AS (SELECT 'w' AS name, CAST(i AS INT) AS i, CAST(j AS INT) AS j, avg(v) AS v FROM r GROUP BY i, j)"


def fsdp_shards(spark, d):
    """The table's matrix on two shards by rows, and its mean row on both."""
    whole = table_params(spark, d).drop("label")
    mean = whole.groupBy("j").agg(F.avg("v").alias("v")).select(F.lit("mean").alias("name"), F.lit(0).alias("i"), "j", "v")
    s = optim.sharded(whole.unionByName(mean), 2)
    return s.groupBy("name", "shard").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total")).withColumn("total", F.col("total") + F.lit(0.0))


FSDP_SQL = f"""WITH {TABLE}, r AS (SELECT max(i) + 1 AS r FROM p),
s AS (SELECT name, v, CAST(i * 2 // r AS INT) AS shard FROM p, r UNION ALL SELECT 'mean', m.v, CAST(q AS INT) FROM (SELECT j, avg(v) AS v FROM p GROUP BY j) m, range(2) u(q))
SELECT name, shard, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM s GROUP BY name, shard"""


def fsdp_gather(spark, d):
    return optim.gathered(optim.sharded(table_params(spark, d).drop("label"), 3)).select(*optim.KEYS, rounded("v", 9).alias("v"))


def fsdp_reduce_scatter(spark, d):
    return optim.reduce_scattered(rank_grads(spark, d), 4).select("shard", *optim.KEYS, rounded("v").alias("v"))


def sharded_adamw(spark, d):
    """One step on each shard alone, then gathered."""
    st, g = optim.sharded(optim.fresh(params(spark)), 4), written(grads(spark, d), "grads")
    parts = [optim.adamw(st.where(F.col("shard") == k).drop("shard"), g.withColumn("v", F.col("v") * 1.5), 1, lr=0.1, decay=0.1) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _state(out)


def fsdp_half_step(spark, d):
    """Two steps of a linear layer, sharded in four, with half-precision computing; its targets are the first entries of the vectors."""
    rows = vectors(spark, d).select((F.col("vec_id") % 4).cast("int").alias("rank"), "x", F.slice("x", 1, ROWS).alias("y"))
    st = optim.sharded(optim.fresh(params(spark)), 4)
    for t in (1, 2):
        st = written(optim.sharded_step(st, rows, "w", 4, t, half, lr=0.1, decay=0.1), "shards")
    return st.select("shard", *optim.KEYS, rounded("v").alias("v"))


def _half_step_sql() -> str:
    ctes = [
        X, P0, f"hx AS MATERIALIZED (SELECT vec_id, k, {half_sql('v')} AS v FROM x)",
        "s0 AS (SELECT *, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS s FROM p)",
    ]
    for t in (1, 2):
        f1, f2 = f"(1 - pow(CAST(0.9 AS DOUBLE), {t}))", f"(1 - pow(CAST(0.999 AS DOUBLE), {t}))"
        ctes += [
            f"w{t} AS MATERIALIZED (SELECT i, j, {half_sql('v')} AS v FROM s{t - 1})",
            f"o{t} AS MATERIALIZED (SELECT vec_id, i, sum(hx.v * w.v) AS v FROM hx JOIN w{t} w ON hx.k = w.j GROUP BY vec_id, i)",
            f"e{t} AS MATERIALIZED (SELECT o.vec_id, o.i, o.v - hx.v AS e FROM o{t} o JOIN hx ON hx.vec_id = o.vec_id AND hx.k = o.i)",
            f"r{t} AS MATERIALIZED (SELECT e.vec_id % 4 AS rank, i, CAST(k AS INT) AS j, avg(e * hx.v) AS v FROM e{t} e JOIN hx USING (vec_id) GROUP BY ALL)",
            f"a{t} AS MATERIALIZED (SELECT i, j, avg(v) AS v FROM r{t} GROUP BY i, j)",
            f"g{t} AS MATERIALIZED (SELECT i, j, {half_sql('v')} AS g FROM a{t})",
            f"n{t} AS MATERIALIZED (SELECT name, i, j, v, g, CAST(0.9 AS DOUBLE) * m + (1 - CAST(0.9 AS DOUBLE)) * g AS m, CAST(0.999 AS DOUBLE) * s + (1 - CAST(0.999 AS DOUBLE)) * g * g AS s FROM s{t - 1} JOIN g{t} USING (i, j))",
            f"s{t} AS MATERIALIZED (SELECT name, i, j, CAST(CAST(v * (1 - CAST(0.01 AS DOUBLE)) - 0.1 / {f1} * m / (sqrt(s / {f2}) + 1e-8) AS FLOAT) AS DOUBLE) AS v, CAST(CAST(m AS FLOAT) AS DOUBLE) AS m, CAST(CAST(s AS FLOAT) AS DOUBLE) AS s FROM n{t})",
        ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT CAST(i * 4 // {ROWS} AS INT) AS shard, name, i, j, round(v, 6) + 0.0 AS v FROM s2"


def replica_check(spark, d):
    """Four replicas of the table's matrix; one has drifted in the rows of a label."""
    r = table_params(spark, d).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(3))))
    off = r.withColumn("v", F.when((F.col("rank") == 2) & (F.col("label") % 4 == 3), F.col("v") + 0.25).otherwise(F.col("v")))
    return optim.differing_replicas(off, 1e-9).select(*optim.KEYS, rounded("spread").alias("spread"))


# ---- sampling; logits are the vectors


def logits(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("b"), F.posexplode(F.transform("x", lambda v: v * 10.0)).alias("token", "logit"))


def temperature(spark, d):
    return sampling.probabilities(sampling.temperature(logits(spark, d), 0.7)).select("b", "token", rounded("p").alias("p"))


def topp_filter(spark, d):
    return sampling.top_p(sampling.probabilities(logits(spark, d)), 0.6).select("b", "token", rounded("p").alias("p"))


def topk_filter(spark, d):
    return sampling.top_k(logits(spark, d), 5).select("b", "token", rounded("logit").alias("logit"))


def inverse_cdf_sample(spark, d):
    u = vectors(spark, d).select(F.col("vec_id").alias("b"), ((F.col("vec_id") * 7919 + 13) % 1000 / F.lit(1000.0)).alias("u"))
    return sampling.draw(sampling.probabilities(logits(spark, d)), u)


_LOGITS = "l AS MATERIALIZED (SELECT vec_id AS b, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS token, CAST(unnest(embedding) AS DOUBLE) * 10 AS logit FROM embeddings), p AS MATERIALIZED (SELECT b, token, e / sum(e) OVER (PARTITION BY b) AS p FROM (SELECT b, token, exp(logit{} - max(logit{}) OVER (PARTITION BY b)) AS e FROM l))"
_L = _LOGITS.format("", "")


def next_characters(spark, d) -> DataFrame:
    """token, nxt: the character that most often follows each (ties: the smaller)."""
    points = spark.read.parquet(f"{d}/documents.parquet").select(F.expr("if(text = '', cast(array() as array<int>), transform(split(text, ''), c -> ascii(c)))").alias("ids"))
    pairs = points.where("size(ids) > 1").select(F.expr("explode(transform(slice(ids, 1, size(ids) - 1), (c, i) -> struct(c AS token, ids[i + 1] AS nxt)))").alias("x"))
    counts = pairs.groupBy("x.token", "x.nxt").agg(F.count("*").alias("n"))
    return counts.groupBy("token").agg(F.max(F.struct("n", (-F.col("nxt")).alias("m"))).alias("top")).select("token", (-F.col("top.m")).alias("nxt"))


def greedy_generate(spark, d):
    best = written(next_characters(spark, d), "next")
    prompts = spark.range(26).select(F.col("id").alias("b"), F.array((F.col("id") + 97).cast("int")).alias("ids"))
    out = sampling.generate(prompts, best, new=6, end=32)
    return out.select("b", F.array_join("ids", ",").alias("ids"))


_GREEDY = """WITH RECURSIVE p AS (SELECT list_transform(string_split(text, ''), lambda c: unicode(c)) AS ids FROM documents WHERE length(text) > 1),
f AS (SELECT ids[i] AS token, ids[i + 1] AS nxt FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM p)),
n AS (SELECT token, nxt, count(*) AS n FROM f GROUP BY ALL),
t AS MATERIALIZED (SELECT token, nxt FROM (SELECT token, nxt, row_number() OVER (PARTITION BY token ORDER BY n DESC, nxt) AS r FROM n) WHERE r = 1),
g(b, ids, step) AS (SELECT b, [CAST(b + 97 AS INT)], 0 FROM range(26) a(b)
  UNION ALL SELECT g.b, CASE WHEN (len(g.ids) > 1 AND g.ids[-1] = 32) OR t.nxt IS NULL THEN g.ids ELSE list_append(g.ids, t.nxt) END, step + 1 FROM g LEFT JOIN t ON t.token = g.ids[-1] WHERE step < 6)
SELECT b, array_to_string(ids, ',') AS ids FROM g WHERE step = 6"""


def _prompts(spark, d) -> DataFrame:
    ids = vectors(spark, d).select(F.col("vec_id").alias("b"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((F.col("vec_id") * 7 + k * 11) % VOCAB).cast("int")).alias("ids"))
    return ids


def _generate(**options):
    return lambda spark, d: sampling.generate_lm_rows(_prompts(spark, d), lm_weights(), HEADS, new=4, context=6, **options).select("b", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"))


def generate_sql(t: float, kept: str, end: int, keep_end: bool, whole: bool) -> str:
    """Four drawn ids a prompt; in each step the model reads every distinct window of the last six ids once.

    kept: which rows of r (z, p, cum and rank in falling order) may be drawn.
    """
    ctes = [f"g0 AS (SELECT vec_id AS b, list_transform(range(4), lambda k: CAST((vec_id * 7 + k * 11) % {VOCAB} AS INT)) AS ids, false AS done FROM embeddings)"]
    for n in range(4):
        w0, w1 = f"{n}_0", f"{n}_1"
        ctes += [
            f"w{n} AS MATERIALIZED (SELECT win, row_number() OVER () AS b FROM (SELECT DISTINCT ids[-6:] AS win FROM g{n} WHERE NOT done))",
            f"x{n} AS MATERIALIZED (SELECT b, p, k, {weight('win[p + 1]', 'k', 5)} AS v FROM (SELECT *, unnest(range(len(win))) AS p FROM w{n}), range({D}) c(k))",
            *block_ctes(f"x{n}", w0, 10), *block_ctes(f"y{w0}", w1, 30),
            f"e{n} AS (SELECT y.b, y.p, y.k, y.v FROM y{w1} y JOIN w{n} USING (b) WHERE p = len(win) - 1)",
            rms(f"f{n}", f"e{n}", "b, p"), lin(f"z{n}", f"f{n}", VOCAB, 6, "b, p"),
            f"q{n} AS (SELECT b, k, v / {t}::DOUBLE AS z, exp(v / {t}::DOUBLE) / sum(exp(v / {t}::DOUBLE)) OVER (PARTITION BY b) AS p FROM z{n})",
            f"r{n} AS MATERIALIZED (SELECT *, sum(p) OVER (PARTITION BY b ORDER BY p DESC, k ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY b ORDER BY p DESC, k) AS rn, rank() OVER (PARTITION BY b ORDER BY z DESC) AS rk FROM q{n})",
            f"k{n} AS MATERIALIZED (SELECT b, k, sum(p) OVER (PARTITION BY b ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY b) AS upto FROM r{n} WHERE {kept})",
            f"d{n} AS (SELECT g.b, coalesce(min(CASE WHEN upto > (g.b * 7919 + {n} * 104729 + 13) % 1000 / 1000::DOUBLE THEN k END), {VOCAB - 1}) AS token FROM g{n} g JOIN w{n} w ON g.ids[-6:] = w.win JOIN k{n} k ON k.b = w.b WHERE NOT g.done GROUP BY g.b)",
            f"g{n + 1} AS MATERIALIZED (SELECT g.b, CASE WHEN token IS NULL{'' if keep_end else f' OR token = {end}'} THEN ids ELSE list_append(ids, CAST(token AS INT)) END AS ids, done OR token = {end} AS done FROM g{n} g LEFT JOIN d{n} d USING (b))",
        ]
    ids = "ids" if whole else "ids[5:]"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT b, CAST(len({ids}) AS INT) AS n, array_to_string({ids}, ',') AS ids FROM g4"


# ---- training, checkpoints, logs


def _train(spark, d):
    """Trains on four folds of the rows and validates on the fifth, in every second step."""
    rows, fold = vectors(spark, d).withColumn("label", F.col("label") % 4), F.col("vec_id") % 5 == 4
    return training.train_classifier(rows.where(~fold), 4, D, 3, (0.1, 0.01, 1, 4), 0.5, valid=rows.where(fold), eval_every=2)


def train_loop(spark, d):
    _, log = _train(spark, d)
    path = scratch_path(spark, "metrics")
    S.append_log(spark, log, path)
    return S.read_log(spark, path).select("iter", rounded("train_loss").alias("train_loss"), rounded("valid_loss").alias("valid_loss"), rounded("lr", 9).alias("lr"))


def train_loop_sql() -> str:
    lr = lambda t: f"CAST({'0.0' if t == 0 else f'0.01 + 0.5 * (1 + cos(pi() * ({t} - 1) / 3)) * 0.09'} AS DOUBLE)"
    ctes = ["a AS MATERIALIZED (SELECT vec_id, label % 4 AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)", "x AS (SELECT * FROM a WHERE vec_id % 5 <> 4)", "h AS (SELECT * FROM a WHERE vec_id % 5 = 4)", "n AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 5 <> 4)", f"s0 AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS s FROM range(4) a(i), range({D}) b(j))"]
    for t in range(3):
        f1, f2 = f"(1 - pow(CAST(0.9 AS DOUBLE), {t + 1}))", f"(1 - pow(CAST(0.999 AS DOUBLE), {t + 1}))"
        ctes += [
            f"l{t} AS MATERIALIZED (SELECT vec_id, any_value(y) AS y, i, sum(x.v * s.v) AS z FROM x JOIN s{t} s USING (j) GROUP BY vec_id, i)",
            f"p{t} AS MATERIALIZED (SELECT vec_id, y, i, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM l{t})",
            f"loss{t} AS (SELECT -avg(ln(p)) AS loss FROM p{t} WHERE y = i)",
            f"g{t} AS MATERIALIZED (SELECT i, j, sum((p - CASE WHEN p{t}.y = i THEN 1 ELSE 0 END) * v) / any_value(n.n) AS g FROM p{t} JOIN x USING (vec_id), n GROUP BY i, j)",
            f"c{t} AS (SELECT CASE WHEN sqrt(sum(g * g)) <= 0.5 THEN 1 ELSE 0.5 / (sqrt(sum(g * g)) + 1e-6) END AS f FROM g{t})",
            f"u{t} AS MATERIALIZED (SELECT i, j, s.v, CAST(0.9 AS DOUBLE) * m + (1 - CAST(0.9 AS DOUBLE)) * g * f AS m, CAST(0.999 AS DOUBLE) * s + (1 - CAST(0.999 AS DOUBLE)) * g * f * g * f AS s FROM s{t} s JOIN g{t} USING (i, j), c{t})",
            f"s{t + 1} AS MATERIALIZED (SELECT i, j, v * (1 - {lr(t)} * 0.01) - {lr(t)} / {f1} * m / (sqrt(s / {f2}) + 1e-8) AS v, m, s FROM u{t})",
        ]
        ctes += [
            f"vl{t} AS (SELECT vec_id, any_value(y) AS y, i, sum(h.v * s.v) AS z FROM h JOIN s{t + 1} s USING (j) GROUP BY vec_id, i)",
            f"vp{t} AS (SELECT y, i, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM vl{t})",
            f"valid{t} AS (SELECT -avg(ln(p)) AS valid_loss FROM vp{t} WHERE y = i)",
        ] if t % 2 else []
    parts = "\nUNION ALL ".join(f"SELECT CAST({t + 1} AS INT) AS iter, round(loss, 6) + 0.0 AS train_loss, {f'(SELECT round(valid_loss, 6) + 0.0 FROM valid{t})' if t % 2 else 'CAST(NULL AS DOUBLE)'} AS valid_loss, round({lr(t)}, 9) + 0.0 AS lr FROM loss{t}" for t in range(3))
    return "WITH " + ",\n".join(ctes) + "\n" + parts


def checkpoint_roundtrip(spark, d):
    path = scratch_path(spark, "checkpoint")
    for n in (1, 2):
        S.save_checkpoint(_steps(spark, d, n, False), n, path)
    st, n = S.load_checkpoint(spark, path)
    return _state(st).withColumn("iteration", F.lit(n))


def pretrained_names(spark, d):
    """Names of a compiled model whose embedding is the table's matrix."""
    named = parameters(spark).where("name != 'embedding'").unionByName(table_params(spark, d).drop("label").withColumn("name", F.lit("embedding")))
    return V.plain_names(named.withColumn("name", F.concat(F.lit("_orig_mod."), "name"))).groupBy("name").agg(F.count("*").alias("n"))


PRETRAINED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({c} AS BIGINT))" for n, c in _SHAPES if n != "embedding") + f") t(name, n) UNION ALL SELECT 'embedding', count(*) * {D} FROM embeddings"


def pretrained_lm(spark, d):
    """A model saved under compiled names, loaded as a whole and run on the ids of the vectors."""
    path = scratch_path(spark, "model")
    row = spark.createDataFrame([(VOCAB, SEQ, D, 2, HEADS, 128, THETA)], V.CONFIG)
    V.save_model(pretrained(spark), row, path)
    settings, w = V.load_model(spark, path)
    return lm_logits(spark, d, w, settings["num_heads"], settings["rope_theta"])


def pretrained(spark) -> DataFrame:
    """The test model's parameters under the names of a compiled model."""
    flat = {"embedding": (w := lm_weights())["embedding"], "head": w["head"], "ln_final": w["ln_final"][None, :]}
    for n, own in enumerate(w["layers"]):
        flat |= {f"layers.{n}.{k}": m if m.ndim == 2 else m[None, :] for k, m in own.items()}
    rows = [(f"_orig_mod.{name}", m.tolist()) for name, m in flat.items()]
    table = spark.createDataFrame(rows, "name string, m array<array<double>>")
    return table.select("name", F.posexplode("m").alias("i", "r")).select("name", "i", F.posexplode("r").alias("j", "v"))


def snapshot_compare(spark, d):
    """The table's matrix against a copy that lacks some cells and differs in others."""
    a = table_params(spark, d)
    b = a.where("NOT (label % 4 = 1 AND j < 3)").withColumn("v", F.when((F.col("i") % 8 == 4) & (F.col("j") % 16 == 0), F.col("v") + 0.01).otherwise(F.col("v") * (1 + 1e-7)))
    return verify.not_close(a, b, optim.KEYS).select("i", "j", F.col("right_v").isNull().alias("missing"))


def key_compare(spark, d):
    p = table_params(spark, d)
    return verify.different_keys(p.where("label % 4 < 3"), p.where("label % 4 > 0"), optim.KEYS).select("i", "j", "side")


def object_compare(spark, d):
    a = spark.read.parquet(f"{d}/nation.parquet")
    b = a.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("changed")).otherwise(F.col("n_name")))
    return verify.unequal(a, b)


def deviation_bound(spark, d):
    from .text_queries import start_histogram

    h = start_histogram(spark, d)
    return verify.outside_deviations(h, 16_000, 93, 5.0)


_HIST = "SELECT CAST((b * 1103515245 + 12345) % 93 AS BIGINT) AS start, count(*) AS n FROM documents, range(16) t(b) GROUP BY 1"

QUERIES = {
    "lr_cosine": lr_cosine, "grad_norm": grad_norm, "grad_clip": _clip(False), "grad_clip_always": _clip(True), "grad_clip_unchanged": clip_unchanged,
    "adamw_step": _adamw(1), "adamw_three_steps": _adamw(3), "adamw_step_eps_variant": _adamw(2, True),
    "ddp_grad_avg": ddp_grad_avg, "fsdp_shards": fsdp_shards, "fsdp_gather": fsdp_gather, "fsdp_reduce_scatter": fsdp_reduce_scatter, "sharded_adamw": sharded_adamw, "fsdp_half_step": fsdp_half_step, "replica_check": replica_check,
    "temperature": temperature, "topp_filter": topp_filter, "topk_filter": topk_filter, "inverse_cdf_sample": inverse_cdf_sample, "greedy_generate": greedy_generate, "lm_generate_topp": _generate(t=0.8, p=0.9, end=7), "lm_generate_topk": _generate(t=0.8, k=5, end=7, keep_end=False, return_prompt=False),
    "train_loop": train_loop, "checkpoint_roundtrip": checkpoint_roundtrip, "pretrained_names": pretrained_names, "pretrained_lm": pretrained_lm,
    "snapshot_compare": snapshot_compare, "key_compare": key_compare, "object_compare": object_compare, "deviation_bound": deviation_bound,
}
_SHARDED = adamw_sql(1, False)
ORACLES = {
    "lr_cosine": LR_SQL,
    "grad_norm": f"WITH {GRADS} SELECT round(sqrt(sum(v * v)), 9) + 0.0 AS norm FROM g",
    "grad_clip": _CLIP.format("CASE WHEN norm <= 0.01 THEN 1 ELSE 0.01 / (norm + 1e-6) END"),
    "grad_clip_always": _CLIP.format("least(1, 0.01 / (norm + 1e-6))"),
    "grad_clip_unchanged": f"WITH {GRADS} SELECT name, i, j, round(v, 9) + 0.0 AS v FROM g",
    "adamw_step": _SHARDED,
    "adamw_three_steps": adamw_sql(3, False),
    "adamw_step_eps_variant": adamw_sql(2, True),
    "ddp_grad_avg": f"WITH {_RANKS} SELECT name, i, j, round(v, 6) + 0.0 AS v FROM a",
    "fsdp_shards": FSDP_SQL,
    "fsdp_gather": f"WITH {TABLE} SELECT name, i, j, round(v, 9) + 0.0 AS v FROM p",
    "fsdp_reduce_scatter": f"WITH {_RANKS} SELECT CAST(i * 4 // {ROWS} AS INT) AS shard, name, i, j, round(v, 6) + 0.0 AS v FROM a",
    "sharded_adamw": _SHARDED,
    "fsdp_half_step": _half_step_sql(),
    "replica_check": f"WITH {TABLE} SELECT name, i, j, CAST(0.25 AS DOUBLE) AS spread FROM p WHERE label % 4 = 3",
    "temperature": "WITH " + _LOGITS.format(" / 0.7", " / 0.7") + " SELECT b, token, round(p, 6) + 0.0 AS p FROM p",
    "topp_filter": f"WITH {_L}, c AS (SELECT b, token, p, sum(p) OVER (PARTITION BY b ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY b ORDER BY p DESC, token) AS rn FROM p), k AS (SELECT * FROM c WHERE cum <= 0.6 OR rn = 1) SELECT b, token, round(p / sum(p) OVER (PARTITION BY b), 6) + 0.0 AS p FROM k",
    "topk_filter": f"WITH {_L} SELECT b, token, round(logit, 6) + 0.0 AS logit FROM (SELECT *, rank() OVER (PARTITION BY b ORDER BY logit DESC) AS r FROM l) WHERE r <= 5",
    "inverse_cdf_sample": f"WITH {_L}, c AS (SELECT b, token, sum(p) OVER (PARTITION BY b ORDER BY token ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT b, coalesce(min(CASE WHEN cum >= (b * 7919 + 13) % 1000 / CAST(1000 AS DOUBLE) THEN token END), max(token)) AS token FROM c GROUP BY b",
    "greedy_generate": _GREEDY,
    "lm_generate_topp": generate_sql(0.8, "cum <= 0.9 OR rn = 1", 7, True, True),
    "lm_generate_topk": generate_sql(0.8, "rk <= 5", 7, False, False),
    "train_loop": train_loop_sql(),
    "checkpoint_roundtrip": f"SELECT *, CAST(2 AS INT) AS iteration FROM ({adamw_sql(2, False)})",
    "pretrained_names": PRETRAINED_SQL,
    "pretrained_lm": LM_SQL,
    "snapshot_compare": f"WITH {TABLE} SELECT i, j, label % 4 = 1 AND j < 3 AS missing FROM p WHERE (label % 4 = 1 AND j < 3) OR (i % 8 = 4 AND j % 16 = 0)",
    "key_compare": f"WITH {TABLE} SELECT i, j, CASE WHEN label % 4 = 0 THEN 'left' ELSE 'right' END AS side FROM p WHERE label % 4 IN (0, 3)",
    "object_compare": "SELECT n_nationkey, n_name, n_regionkey, 'left' AS side FROM nation WHERE n_nationkey = 3 UNION ALL SELECT n_nationkey, 'changed', n_regionkey, 'right' FROM nation WHERE n_nationkey = 3",
    "deviation_bound": f"SELECT start, n FROM ({_HIST}) WHERE abs(n - 16000 / CAST(93 AS DOUBLE)) > 5 * sqrt(16000 / CAST(93 AS DOUBLE) * (1 - 1 / CAST(93 AS DOUBLE)))",
}
