"""Radial functions as Column expressions: cutoffs, Chebyshev polynomials, complementary error function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def cutoff(kind: str, radius: float, r: Column) -> Column:
    """Cosine or tanh cutoff, zero beyond ``radius``."""
    if kind == "cos":
        inside = 0.5 * (F.cos(F.lit(math.pi) * r / radius) + 1.0)
    elif kind == "tanh":
        t = F.tanh(1.0 - r / radius)
        inside = t * t * t
    else:
        raise ValueError(f"unknown cutoff: {kind}")
    return F.when(r <= radius, inside).otherwise(F.lit(0.0))


def chebyshev(order: int, t: Column) -> Column:
    """T_n(t) on [-1, 1] in closed form."""
    return F.cos(F.lit(float(order)) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t))))


def erfc(a: Column) -> Column:
    """Complementary error function by the rational approximation of Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    x = F.abs(a)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-(x * x))
    return F.when(a >= 0, tail).otherwise(2.0 - tail)


@F.pandas_udf(DoubleType())
def erfc_exact(a):
    """Complementary error function to full precision, over Arrow batches."""
    return a.map(math.erfc)
