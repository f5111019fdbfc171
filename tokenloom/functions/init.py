"""Parameter initialisation as column functions: draws that depend on (seed, name, i, j) only, whoever computes them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's published rational approximation of the inverse normal distribution (relative error below 1.2e-9).
CENTRE = ([-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
          [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0])
TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
        [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0])
BREAK = 0.02425
#: Hexadecimal digits of a digest that make a uniform number.
DIGITS = 13


def uniform(seed: int, name: Column, i: Column, j: Column) -> Column:
    """A number inside (0, 1) from the digest of seed:name:i:j."""
    key = F.concat_ws(":", F.lit(str(seed)), name, i.cast("string"), j.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The deviation below which a normal draw lies with probability p."""
    low = F.sqrt(F.log(F.least(p, 1 - p)) * -2)
    q = p - 0.5
    tail = _poly(TAIL[0], low) / _poly(TAIL[1], low)
    centre = q * _poly(CENTRE[0], q * q) / _poly(CENTRE[1], q * q)
    return F.when(p < BREAK, tail).when(p > 1 - BREAK, -tail).otherwise(centre)


def truncated_normal(u: Column, std: Column | float, cut: float = 3.0) -> Column:
    """A normal draw with mean 0, kept within cut deviations, from a uniform u: the distribution is cut, not the draw."""
    outside = 0.5 * math.erfc(cut / math.sqrt(2))
    return inverse_normal(u * (1 - 2 * outside) + outside) * std


def linear_std(rows: int, columns: int) -> float:
    return math.sqrt(2.0 / (rows + columns))
