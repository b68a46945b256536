"""Numeric columns: vectors, intervals, fusion and pricing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054
RRF = 60


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector of length one; null for a zero or non-finite one."""
    norm = F.sqrt(dot(a, a))
    return F.when((norm > 0) & ~F.isnan(norm) & (norm < F.lit(float("inf"))), F.transform(a, lambda x: x.cast("double") / norm))


def wilson(correct: Column, total: Column) -> tuple[Column, Column]:
    """Both ends of a binomial interval of 95 %; null without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = correct / n
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    margin = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return centre - margin, centre + margin


def rrf(rank: Column, constant: int = RRF) -> Column:
    return 1.0 / (constant + rank)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def usage_cost(uncached: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Cost of token counts at prices for a million tokens; negative counts fail."""
    ok = F.assert_true((uncached >= 0) & (cached >= 0) & (output >= 0), "token counts must not be negative")
    cost = (uncached * prices[0] + cached * prices[1] + output * prices[2]) / 1e6
    return F.when(ok.isNull(), cost)


def leaf_target(n: Column) -> Column:
    """Leaves that a region of n documents is to have: half-even rounding of sqrt(n / 10), 2 to 24; one below 24 documents."""
    return F.when(n < 24, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(24), F.rint(F.sqrt(n / 10.0)).cast("int"))))
