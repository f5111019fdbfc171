"""Row-wise tensor functions on array<double> columns; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(c: Column | str) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, not once for each element that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    """Residual addition."""
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(x: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, float) else by
    return F.transform(x, lambda v: v * by)


def matrix(rows: int, columns: int, cell: Callable[[Column, Column], Column]) -> Column:
    """array<array<double>> whose cell (i, j) is cell(i, j)."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: cell(i, j)))


def linear(x: Column, w: Column) -> Column:
    """y = x W^T without bias; w is an array of rows (out, in)."""
    return F.transform(w, lambda row: dot(x, row))


def rms_norm(x: Column, gain: Column, eps: float = 1e-5) -> Column:
    """x / sqrt(mean(x^2) + eps) * gain."""
    size = F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + F.lit(eps))
    return let(size, lambda s: F.zip_with(x, gain, lambda v, g: v / s * g))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (F.lit(1.0) + F.exp(-v)))


def swiglu(x: Column, w1: Column, w2: Column, w3: Column) -> Column:
    """W2 (silu(W1 x) * W3 x)."""
    return linear(F.zip_with(silu(linear(x, w1)), linear(x, w3), lambda a, b: a * b), w2)


def silu_ffn(x: Column, w1: Column, w2: Column) -> Column:
    return linear(silu(linear(x, w1)), w2)


def ffn_width(d: int, ablation: bool = False) -> int:
    """Default hidden width: 8d/3 cut to an integer and rounded up to a multiple of 64; 4d for the ablation."""
    return 4 * d if ablation else -(-int(8 * d / 3) // 64) * 64


def rope(x: Column, position: Column, theta: float = 10000.0, halves: bool = False) -> Column:
    """Rotates pairs (2i, 2i+1) by position * theta^(-2i/d); halves puts first parts before second parts."""
    d = F.size(x)
    angle = lambda pair: position * F.pow(F.lit(theta), -(pair * 2) / d)
    first = lambda pair: F.get(x, pair * 2) * F.cos(angle(pair)) - F.get(x, pair * 2 + 1) * F.sin(angle(pair))
    second = lambda pair: F.get(x, pair * 2) * F.sin(angle(pair)) + F.get(x, pair * 2 + 1) * F.cos(angle(pair))
    pairs = F.sequence(F.lit(0), (d / 2).cast("int") - 1)
    if halves:
        return F.concat(F.transform(pairs, first), F.transform(pairs, second))
    return F.flatten(F.transform(pairs, lambda p: F.array(first(p), second(p))))


def softmax(x: Column) -> Column:
    """Shifted by the maximum."""
    shifted = lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t))
    return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)), shifted))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(total(F.transform(x, lambda v: F.exp(v - m)))))


def log_softmax(x: Column) -> Column:
    return let(log_sum_exp(x), lambda t: F.transform(x, lambda v: v - t))


def half(v: Column) -> Column:
    """v rounded to half precision (11 significant bits, ties to even, gradual underflow), as a double; beyond 65504 infinite."""
    quantum = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
    near = F.when(v == 0, v).otherwise(F.rint(v / quantum) * quantum)
    return F.when(F.abs(near) > 65504, F.signum(v) * F.lit(float("inf"))).otherwise(near)


def linear_half(x: Column, w: Column) -> Column:
    """y = x W^T of half-precision copies of both; sums are not rounded, and x and w stay as they are."""
    copy = lambda r: F.transform(r, half)
    return let(copy(x), lambda y: F.transform(w, lambda row: dot(y, copy(row))))
