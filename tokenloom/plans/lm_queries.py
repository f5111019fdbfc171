"""Language-model training queries: initialisation, bigram steps over documents, Transformer steps over benchmark texts.

The oracles spell the same out in SQL: reverse mode as joins and sums over (sequence, position, feature) rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import init
from ..operators import lm, windows
from .tensor_queries import rounded

#: Bigram: token ids are code points modulo BIGRAM. Transformer: sizes of the trained model.
BIGRAM = 64
VOCAB, D, FF, HEADS, CONTEXT, SEED, THETA = 32, 16, 32, 2, 16, 11, 10000.0
STEPS = 3
BIGRAM_RATE, BIGRAM_NORM = (0.5, 0.05, 1, 4), 0.05
LM_RATE, LM_NORM = (0.02, 0.002, 1, 4), 0.5


def _ids(modulus: int):
    return F.expr(f"if(text IS NULL OR text = '', cast(array() as array<int>), transform(split(text, ''), c -> ascii(c) % {modulus}))").alias("ids")


def truncated_normal(spark, d):
    """A draw for every entry of embeddings, at twice the deviation of a layer from its width to 16."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    u = init.uniform(SEED, F.lit("embedding"), F.col("vec_id"), F.col("k"))
    return rows.select("vec_id", "k", rounded(init.truncated_normal(u, 2 * init.linear_std(16, 64)), 9).alias("v"))


def _log(log) -> list[tuple]:
    return [(r["iter"], r["train_loss"], r["valid_loss"], r["lr"]) for r in log]


def _logged(spark, log):
    rows = spark.createDataFrame(_log(log), "iter int, train_loss double, valid_loss double, lr double")
    return rows.select("iter", rounded("train_loss").alias("train_loss"), rounded("valid_loss").alias("valid_loss"), rounded("lr", 9).alias("lr"))


def bigram_train(spark, d):
    """Trains on four folds of the documents, validates on the fifth."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", _ids(BIGRAM))
    fold = F.col("doc_id") % 5 == 4
    _, log = lm.train_bigram(docs.where(~fold), BIGRAM, STEPS, BIGRAM_RATE, BIGRAM_NORM, valid=docs.where(fold))
    return _logged(spark, log)


def _trained(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), _ids(VOCAB))
    seqs = windows.windows(items, context=CONTEXT, step=CONTEXT, last=True)
    return lm.train_lm(seqs, lm.initial(spark, VOCAB, D, FF, 1, SEED), HEADS, STEPS, LM_RATE, LM_NORM)


def lm_train(spark, d):
    return _logged(spark, _trained(spark, d)[1])


def lm_train_parameters(spark, d):
    """Every parameter of the Transformer after the steps."""
    return _trained(spark, d)[0].select("name", "i", "j", rounded("v", 5).alias("v"))


# ---- oracles


def _poly(cs: list[float], x: str) -> str:
    out = f"CAST({cs[0]!r} AS DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def draw_sql(seed: int, name: str, i: str, j: str, std: str) -> str:
    """The truncated normal draw; u and the low tail's argument are worked out where they stand."""
    import math

    outside = 0.5 * math.erfc(3 / math.sqrt(2))
    u = f"((CAST('0x' || substr(md5('{seed}:' || {name} || ':' || {i} || ':' || {j}), 1, {init.DIGITS}) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({float(16**init.DIGITS)!r} AS DOUBLE))"
    p = f"({u} * CAST({1 - 2 * outside!r} AS DOUBLE) + CAST({outside!r} AS DOUBLE))"
    low, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    tail, centre = f"{_poly(init.TAIL[0], low)} / {_poly(init.TAIL[1], low)}", f"{q} * {_poly(init.CENTRE[0], f'({q} * {q})')} / {_poly(init.CENTRE[1], f'({q} * {q})')}"
    return f"CASE WHEN {p} < {init.BREAK} THEN {tail} WHEN {p} > {1 - init.BREAK} THEN -({tail}) ELSE {centre} END * ({std})"


TRUNCATED_SQL = f"SELECT vec_id, k, round({draw_sql(SEED, chr(39) + 'embedding' + chr(39), 'vec_id', 'k', repr(2 * init.linear_std(16, 64)))}, 9) + 0.0 AS v FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS k FROM embeddings)"


def rate_sql(t: int, top: float, bottom: float, warmup: int, cycle: int) -> str:
    if t < warmup:
        return f"CAST({t / max(1, warmup) * top!r} AS DOUBLE)"
    return f"CAST({bottom} + (1 + cos(pi() * {(t - warmup) / max(1, cycle - warmup)!r})) * {(top - bottom) / 2!r} AS DOUBLE)"


def adam_ctes(t: int, most: float, rate: tuple) -> list[str]:
    """s{t+1} (name, i, j, v, m, s) from s{t} and gradients g{t}."""
    lr = rate_sql(t, *rate)
    return [
        f"c{t} AS (SELECT CASE WHEN sqrt(sum(v * v)) <= {most} THEN 1 ELSE {most} / (sqrt(sum(v * v)) + 1e-6) END AS f FROM g{t})",
        f"u{t} AS MATERIALIZED (SELECT name, i, j, s.v, 0.9::DOUBLE * m + 0.1::DOUBLE * g.v * f AS m, 0.999::DOUBLE * s + (1 - 0.999::DOUBLE) * g.v * f * g.v * f AS s FROM s{t} s JOIN g{t} g USING (name, i, j), c{t})",
        f"s{t + 1} AS MATERIALIZED (SELECT name, i, j, v * (1 - {lr} * 0.01) - {lr} / (1 - pow(0.9::DOUBLE, {t + 1})) * m / (sqrt(s / (1 - pow(0.999::DOUBLE, {t + 1}))) + 1e-8) AS v, m, s FROM u{t})",
    ]


def bigram_sql() -> str:
    ctes = [
        f"t AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c) % {BIGRAM}) AS ids FROM documents WHERE length(text) > 1)",
        "f AS (SELECT doc_id % 5 = 4 AS held, CAST(ids[k] AS INT) AS i, CAST(ids[k + 1] AS INT) AS j FROM (SELECT doc_id, ids, unnest(range(1, len(ids))) AS k FROM t))",
        "n AS MATERIALIZED (SELECT held, i, j, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY ALL)",
        f"s0 AS (SELECT 'w' AS name, CAST(a AS INT) AS i, CAST(b AS INT) AS j, 0::DOUBLE AS v, 0::DOUBLE AS m, 0::DOUBLE AS s FROM range({BIGRAM}) x(a), range({BIGRAM}) y(b))",
        "r AS (SELECT i, sum(n) AS row FROM n WHERE NOT held GROUP BY i)",
        "total AS (SELECT sum(n) AS total FROM n WHERE NOT held)",
    ]
    p = lambda t: f"p{t} AS MATERIALIZED (SELECT i, j, exp(v) / sum(exp(v)) OVER (PARTITION BY i) AS p FROM s{t})"
    loss = lambda t, held: f"(SELECT -sum(n * ln(p)) / sum(n) FROM p{t} JOIN n USING (i, j) WHERE {'held' if held else 'NOT held'})"
    for t in range(STEPS):
        ctes += [p(t), f"g{t} AS MATERIALIZED (SELECT 'w' AS name, i, j, (coalesce(row, 0) * p - coalesce(n, 0)) / total AS v FROM p{t} LEFT JOIN r USING (i) LEFT JOIN (SELECT * FROM n WHERE NOT held) USING (i, j), total)", *adam_ctes(t, BIGRAM_NORM, BIGRAM_RATE)]
    rows = [f"SELECT CAST({t + 1} AS INT) AS iter, round({loss(t, False)}, 6) AS train_loss, round({loss(t + 1, True)}, 6) AS valid_loss, round({rate_sql(t, *BIGRAM_RATE)}, 9) AS lr" for t in range(STEPS)]
    return "WITH " + ",\n".join([*ctes, p(STEPS)]) + "\n" + "\nUNION ALL ".join(rows)


def step_ctes(t: int) -> list[str]:
    """Loss l{t} and gradients g{t} of the one-layer model with parameters s{t}, over windows win (b, p, x, y)."""
    out: list[str] = []
    grads: list[str] = []
    head = D // HEADS

    def cte(name: str, sql: str) -> str:
        out.append(f"{name}_{t} AS MATERIALIZED ({sql})")
        return f"{name}_{t}"

    def linear(name: str, src: str, w: str) -> str:
        return cte(name, f"SELECT b, p, w.i AS k, sum(a.v * w.v) AS v FROM {src} a JOIN s{t} w ON w.name = '{w}' AND w.j = a.k GROUP BY b, p, w.i")

    def linear_back(name: str, dy: str, x: str, w: str) -> str:
        grads.append(f"SELECT '{w}' AS name, CAST(d.k AS INT) AS i, CAST(a.k AS INT) AS j, sum(d.v * a.v) AS v FROM {dy} d JOIN {x} a USING (b, p) GROUP BY ALL")
        return cte(name, f"SELECT b, p, w.j AS k, sum(a.v * w.v) AS v FROM {dy} a JOIN s{t} w ON w.name = '{w}' AND w.i = a.k GROUP BY b, p, w.j")

    def norm(name: str, src: str, w: str) -> str:
        return cte(name, f"SELECT b, p, k, a.v AS x, a.root, a.v * a.root * w.v AS v, w.v AS gain FROM (SELECT *, 1 / sqrt(avg(v * v) OVER (PARTITION BY b, p) + 1e-5) AS root FROM {src}) a JOIN s{t} w ON w.name = '{w}' AND w.j = a.k")

    def norm_back(name: str, dy: str, normed: str, w: str) -> str:
        grads.append(f"SELECT '{w}', CAST(0 AS INT), CAST(k AS INT), sum(d.v * a.x * a.root) FROM {dy} d JOIN {normed} a USING (b, p, k) GROUP BY k")
        return cte(name, f"SELECT b, p, k, root * t - x * root * root * root * avg(t * x) OVER (PARTITION BY b, p) AS v FROM (SELECT b, p, k, a.x, a.root, d.v * a.gain AS t FROM {dy} d JOIN {normed} a USING (b, p, k))")

    def turned(name: str, src: str, sign: str = "") -> str:
        angle = f"({sign}a.p * pow({THETA}::DOUBLE, -(a.k % {head} - a.k % 2) / {head}::DOUBLE))"
        return cte(name, f"SELECT a.b, a.p, a.k, CASE WHEN a.k % 2 = 0 THEN a.v * cos({angle}) - o.v * sin({angle}) ELSE o.v * sin({angle}) + a.v * cos({angle}) END AS v FROM {src} a JOIN {src} o ON a.b = o.b AND a.p = o.p AND o.k = xor(a.k, 1)")

    def plus(name: str, *of: str) -> str:
        return cte(name, "SELECT b, p, k, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT b, p, k, v FROM {o}" for o in of) + ") GROUP BY b, p, k")

    h = f"k // {head}"
    x0 = cte("x0", f"SELECT b, p, w.j AS k, w.v FROM win JOIN s{t} w ON w.name = 'embedding' AND w.i = win.x")
    n1 = norm("n1", x0, "layers.0.ln1")
    q, k, v = (linear(c, n1, f"layers.0.{c}") for c in "qkv")
    qr, kr = turned("qr", q), turned("kr", k)
    sc = cte("sc", f"SELECT q.b, q.p, c.p AS s, q.{h} AS h, sum(q.v * c.v) / sqrt({head}::DOUBLE) AS v FROM {qr} q JOIN {kr} c ON q.b = c.b AND q.k = c.k AND c.p <= q.p GROUP BY ALL")
    pr = cte("pr", f"SELECT b, p, s, h, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY b, p, h) AS w FROM (SELECT *, max(v) OVER (PARTITION BY b, p, h) AS m FROM {sc})")
    at = cte("at", f"SELECT pr.b, pr.p, u.k, sum(w * u.v) AS v FROM {pr} pr JOIN {v} u ON pr.b = u.b AND pr.s = u.p AND pr.h = u.{h} GROUP BY ALL")
    mid = plus("mid", x0, linear("o", at, "layers.0.o"))
    n2 = norm("n2", mid, "layers.0.ln2")
    a, c = linear("a", n2, "layers.0.w1"), linear("c", n2, "layers.0.w3")
    gate = cte("gate", f"SELECT b, p, k, a.v AS a, c.v AS c, 1 / (1 + exp(-a.v)) AS s, a.v / (1 + exp(-a.v)) * c.v AS v FROM {a} a JOIN {c} c USING (b, p, k)")
    y = plus("y", mid, linear("ff", gate, "layers.0.w2"))
    fin = norm("fin", y, "ln_final")
    lg = linear("lg", fin, "head")
    pb = cte("pb", f"SELECT b, p, k, exp(v) / sum(exp(v)) OVER (PARTITION BY b, p) AS pr FROM {lg}")
    out.append(f"l{t} AS (SELECT -avg(ln(pr)) AS loss FROM {pb} JOIN win USING (b, p) WHERE k = y)")
    dl = cte("dl", f"SELECT b, p, k, (pr - CASE WHEN k = y THEN 1 ELSE 0 END) / (SELECT count(*) FROM win) AS v FROM {pb} JOIN win USING (b, p)")
    dy = norm_back("dy", linear_back("dfin", dl, fin, "head"), fin, "ln_final")
    dg = linear_back("dg", dy, gate, "layers.0.w2")
    da = cte("da", f"SELECT b, p, k, d.v * g.c * g.s * (1 + g.a * (1 - g.s)) AS v FROM {dg} d JOIN {gate} g USING (b, p, k)")
    dc = cte("dc", f"SELECT b, p, k, d.v * g.a * g.s AS v FROM {dg} d JOIN {gate} g USING (b, p, k)")
    dn2 = plus("dn2", linear_back("dn2a", da, n2, "layers.0.w1"), linear_back("dn2c", dc, n2, "layers.0.w3"))
    dmid = plus("dmid", dy, norm_back("dm", dn2, n2, "layers.0.ln2"))
    do = linear_back("do", dmid, at, "layers.0.o")
    dp = cte("dp", f"SELECT pr.b, pr.p, pr.s, pr.h, any_value(pr.w) AS w, sum(d.v * u.v) AS v FROM {pr} pr JOIN {do} d ON pr.b = d.b AND pr.p = d.p AND pr.h = d.{h} JOIN {v} u ON pr.b = u.b AND pr.s = u.p AND u.k = d.k GROUP BY pr.b, pr.p, pr.s, pr.h")
    ds = cte("ds", f"SELECT b, p, s, h, w * (v - sum(v * w) OVER (PARTITION BY b, p, h)) / sqrt({head}::DOUBLE) AS v FROM {dp}")
    dq = turned("dq", cte("dqr", f"SELECT ds.b, ds.p, c.k, sum(ds.v * c.v) AS v FROM {ds} ds JOIN {kr} c ON ds.b = c.b AND ds.s = c.p AND ds.h = c.{h} GROUP BY ALL"), "-")
    dk = turned("dk", cte("dkr", f"SELECT ds.b, ds.s AS p, c.k, sum(ds.v * c.v) AS v FROM {ds} ds JOIN {qr} c ON ds.b = c.b AND ds.p = c.p AND ds.h = c.{h} GROUP BY ALL"), "-")
    dv = cte("dv", f"SELECT pr.b, pr.s AS p, d.k, sum(w * d.v) AS v FROM {pr} pr JOIN {do} d ON pr.b = d.b AND pr.p = d.p AND pr.h = d.{h} GROUP BY ALL")
    dn1 = plus("dn1", *(linear_back(f"dn1{c}", dx, n1, f"layers.0.{c}") for c, dx in zip("qkv", (dq, dk, dv))))
    dx0 = plus("dx0", dmid, norm_back("dx", dn1, n1, "layers.0.ln1"))
    grads.append(f"SELECT 'embedding', CAST(x AS INT), CAST(k AS INT), sum(v) FROM {dx0} JOIN win USING (b, p) GROUP BY x, k")
    seen = " UNION ALL ".join(grads)
    out.append(f"g{t} AS MATERIALIZED (SELECT name, i, j, coalesce(g.v, 0) AS v FROM s{t} LEFT JOIN ({seen}) g USING (name, i, j))")
    return out


def lm_sql(last: str) -> str:
    shapes = [("embedding", VOCAB, D), ("head", VOCAB, D), ("ln_final", 1, D), *((f"layers.0.{c}", D, D) for c in "qkvo"), ("layers.0.w1", FF, D), ("layers.0.w3", FF, D), ("layers.0.w2", D, FF), ("layers.0.ln1", 1, D), ("layers.0.ln2", 1, D)]
    values = ", ".join(f"('{n}', {r}, {c}, {1.0 if n == 'embedding' else init.linear_std(r, c)!r}::DOUBLE)" for n, r, c in shapes)
    cells = f"SELECT name, CAST(i AS INT) AS i, CAST(j AS INT) AS j, std FROM (SELECT *, unnest(range(c)) AS j FROM (SELECT *, unnest(range(r)) AS i FROM (VALUES {values}) t(name, r, c, std)))"
    ctes = [
        f"s0 AS MATERIALIZED (SELECT name, i, j, CASE WHEN contains(name, 'ln') THEN 1 ELSE {draw_sql(SEED, 'name', 'i', 'j', 'std')} END AS v, 0::DOUBLE AS m, 0::DOUBLE AS s FROM ({cells}))",
        f"t AS (SELECT item_id, list_transform(string_split(text, ''), lambda c: unicode(c) % {VOCAB}) AS ids FROM benchmark WHERE length(text) > {CONTEXT})",
        f"st AS (SELECT item_id, ids, unnest(list_distinct(range(0, len(ids) - {CONTEXT}, {CONTEXT}) || [len(ids) - {CONTEXT + 1}])) AS start FROM t)",
        f"win AS MATERIALIZED (SELECT b, p, ids[start + p + 1] AS x, ids[start + p + 2] AS y FROM (SELECT *, unnest(range({CONTEXT})) AS p FROM (SELECT *, row_number() OVER () AS b FROM st)))",
    ]
    for t in range(STEPS):
        ctes += step_ctes(t) + adam_ctes(t, LM_NORM, LM_RATE)
    return "WITH " + ",\n".join(ctes) + "\n" + last


LM_TRAIN_SQL = lm_sql("\nUNION ALL ".join(f"SELECT CAST({t + 1} AS INT) AS iter, round(loss, 6) AS train_loss, CAST(NULL AS DOUBLE) AS valid_loss, round({rate_sql(t, *LM_RATE)}, 9) AS lr FROM l{t}" for t in range(STEPS)))
LM_PARAMETERS_SQL = lm_sql(f"SELECT name, i, j, round(v, 5) + 0.0 AS v FROM s{STEPS}")

QUERIES = {"truncated_normal": truncated_normal, "bigram_train": bigram_train, "lm_train": lm_train, "lm_train_parameters": lm_train_parameters}
ORACLES = {"truncated_normal": TRUNCATED_SQL, "bigram_train": bigram_sql(), "lm_train": LM_TRAIN_SQL, "lm_train_parameters": LM_PARAMETERS_SQL}
