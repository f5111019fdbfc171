"""Embedding whitening by a compensated covariance (operator 12).

Entries are fixed-point numbers x = floor(256 * c). The covariance is that of the distinct x vectors: n*x - S (S the sums) is
the centred vector times n, an exact integer. Each block of rows is cut into slices of ``SLICE`` bits, an error-free
transformation: products of slices, summed over ``ROWS`` rows, stay below 2**53, so that plain matrix products are exact.
They are accumulated in double-double (two-sum), a high and a low part an entry, and the parts of tasks are merged, 64 at a time
in the order of the tasks, by the same two-sum: no order of rows and no retry changes the covariance in double precision.

The eigen-solve works on one dimensions-by-dimensions matrix: tridiagonal divide and conquer (LAPACK's syevd) and two
rounds of refinement against high and low parts together (Ogita and Aishima 2018), so components are good to double precision.

Edge cases: a null or empty vector, or one with a null, NaN or infinite entry, is left out; so is one of another length than most
vectors have (of equal counts, the greater length). x of entries beyond 2**55 stops at the ends of a long. A component
without variance has null whitened values and is left out of identity_error; fewer than ``COMPONENTS`` dimensions give as many
components; a trace of zero gives a null share; a deviation beyond a long is null; no vector at all gives no row. Repeated rows stay rows, also without
vec_id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, small_batches, written

COMPONENTS = 4
SCALE = 256
#: Rows of a block and bits of a slice: 2 * SLICE + log2(ROWS) is at most 52.
ROWS, SLICE = 1024, 21
#: Parts of tasks that one group merges.
FAN_IN = 64


class Model(NamedTuple):
    """What whitening needs, all of it of the size of the dimensions."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    explained: np.ndarray


def fixed_point(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, x (array<bigint>) of the rows whose vector is whole."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
    rows = rows.select("vec_id", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("m")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("m")).head(1)
    return rows.where(F.size("x") == (lengths[0]["m"] if lengths else 0))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of (high, low) and (more, more_low)."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.asarray(more_low) + np.zeros_like(low))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers (int64, or Python's beyond) as float slices of SLICE bits with the sign of floor division; their sum, by places, is y."""
    out, half = [], 1 << (SLICE - 1)
    while len(out) < 2 or np.any(y != 0):
        low = ((y + half) & ((1 << SLICE) - 1)) - half
        out.append(low.astype(float))
        y = (y - low) >> SLICE
    return out


def gram(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y'y of whole numbers in double-double."""
    high = np.zeros((y.shape[1], y.shape[1]))
    low = np.zeros_like(high)
    for at in range(0, len(y), ROWS):
        parts = slices(y[at : at + ROWS])
        for a, p in enumerate(parts):
            for b, q in enumerate(parts):
                high, low = add(high, low, np.ldexp(p.T @ q, SLICE * (a + b)))
    return high, low


def centred(x: np.ndarray, n: int, sums: list[int], peak: int) -> np.ndarray:
    """n*x - S, exact; peak: the largest |x|. Numbers beyond 62 bits are Python's."""
    if 2 * n * max(peak, 1) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=np.int64)


def _merged(parts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of parts (part, high, low), FAN_IN at a time; one row reaches the driver."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        high = np.zeros(len(pdf["high"].iloc[0]))
        low = np.zeros_like(high)
        for h, e in zip(pdf["high"], pdf["low"]):
            high, low = add(high, low, np.asarray(h), np.asarray(e))
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // FAN_IN], "high": [high], "low": [low]})

    while True:
        parts = parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(merge, "part bigint, high array<double>, low array<double>")
        count = -(-count // FAN_IN)
        if count <= 1:
            row = parts.head()
            return np.array(row["high"]), np.array(row["low"])


def _summed(rows: DataFrame, of, shape: int) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum over all rows' x of what of makes of each batch: a (high, low) of the given length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        high, low = np.zeros(shape), np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                high, low = add(high, low, *of(_matrix(pdf["x"])))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "high": [high], "low": [low]})

    parts = rows.select("x").mapInPandas(run, "part bigint, high array<double>, low array<double>")
    return _merged(parts, rows.rdd.getNumPartitions())


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric high + low."""
    whole = high.astype(np.longdouble) + low.astype(np.longdouble)
    scale = np.max(np.abs(whole)) or np.longdouble(1)
    a = whole / scale
    values, vectors = np.linalg.eigh(a.astype(float))
    q = vectors.astype(np.longdouble)
    for _ in range(2):
        r = np.eye(len(a), dtype=np.longdouble) - q.T @ q
        s = q.T @ a @ q
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        near = 2 * np.sqrt((s - np.diag(np.diag(s))).astype(float) ** 2).max(initial=0) + 1e-18
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(np.abs(gap) > near, (s + e[None, :] * r) / np.where(gap == 0, 1, gap), r / 2)
        q = q + q @ step
    q = q + q @ (np.eye(len(a), dtype=np.longdouble) - q.T @ q) / 2  # back to right angles, which close values cost
    order = np.argsort(-e, kind="stable")
    q = q[:, order] / np.sqrt((q[:, order] ** 2).sum(axis=0))
    return (e[order] * scale).astype(float), q.astype(float)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Model | None, float]:
    """The model of the distinct x of rows, and the identity error of its whitened fit list; None for no rows."""
    spark = session(rows)
    small_batches(spark)
    listed = written(rows.select("x").distinct(), "whitening-fit")
    first = listed.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("m"), F.max(F.expr("aggregate(x, cast(0 as decimal(20, 0)), (p, v) -> greatest(p, abs(cast(v as decimal(20, 0)))))")).alias("peak")).head()
    n, m = first["n"], first["m"]
    if not n:
        return None, float("nan")
    peak = int(first["peak"])
    totals = listed.agg(*[F.sum(F.col("x")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(m)]).head()
    sums = [int(v) for v in totals]

    def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = gram(centred(x, n, sums, peak))
        return high.ravel(), low.ravel()

    high, low = (v.reshape(m, m) for v in _summed(listed, products, m * m))
    values, vectors = eigen(high, low)
    trace = float(np.trace(high) + np.trace(low))
    cube = float(n) ** 3
    values = np.where(values > trace * m * np.finfo(float).eps ** 2, values, 0.0)[:components]
    model = Model(n, sums, values / cube, vectors[:, :components], values / trace if trace else np.full(len(values), np.nan))
    live = np.flatnonzero(model.values > 0)

    def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = projected(model, x, peak)[:, live]
        out = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        return out, np.zeros_like(out)

    if not len(live):
        return model, 0.0
    sums_w, lost = _summed(listed, moments, len(live) * (len(live) + 1))
    got = (sums_w + lost) / n
    mean, square = got[: len(live)], got[len(live) :].reshape(len(live), len(live))
    return model, float(np.max(np.abs(square - np.outer(mean, mean) - np.eye(len(live)))))


def projected(model: Model, x: np.ndarray, peak: int | None = None) -> np.ndarray:
    """Whitened rows of x, a column a component; NaN where a component has no variance."""
    y = centred(x, model.n, model.sums, peak if peak is not None else int(np.max(np.abs(x.astype(float)), initial=0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values > 0, ((y.astype(float) / model.n) @ model.vectors) / np.sqrt(model.values), np.nan)


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened and explained (arrays by component) and identity_error of every row with a whole vector."""
    rows = fixed_point(df)
    kind = dict(rows.dtypes)["vec_id"]
    shape = f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    model, error = fit(rows, components)
    if model is None:
        return session(df).createDataFrame([], shape)
    most = (1 << 63) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share = [None if np.isnan(v) else float(v) for v in model.explained]
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["x"])
            peak = int(np.max(np.abs(x.astype(float))))
            y = centred(x, model.n, model.sums, peak)
            if y.dtype == object or float(np.max(np.abs(y.astype(float)))) ** 2 * x.shape[1] >= most:
                y = y.astype(object)
            deviation = [int(d) if int(d) <= most else None for d in (y * y).sum(axis=1)]
            values = [[None if np.isnan(v) else float(v) for v in r] for r in projected(model, x, peak)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n": model.n, "deviation": pd.array(deviation, dtype="Int64"), "whitened": values, "explained": [share] * len(pdf), "identity_error": error})

    return rows.mapInPandas(run, shape)


def by_component(df: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    each = whitened(df).select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "w"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("w").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error")
