"""Distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of Lanczos's approximation of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
STEPS, TINY = 120, 1e-300


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x >= 0.5."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method in STEPS double steps."""
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def step(s, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / away(1 + even * s.d), away(1 + even / s.c)
        d2, c2 = 1 / away(1 + odd * d1), away(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s.h * d1 * c1 * d2 * c2).alias("h"))

    first = 1 / away(1 - (a + b) * x / (a + 1))
    ones = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    return F.aggregate(ones, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s.h)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), for a, b >= 0.5 and x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    near = x < (a + 1) / (a + b + 2)
    inside = F.when(near, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation of n pairs, by Student's distribution of n - 2 degrees of freedom; NULL for
    fewer than three pairs or no correlation."""
    degrees = n.cast("double") - 2
    return F.when(r.isNull() | (n < 3), F.lit(None).cast("double")).otherwise(incomplete_beta(degrees / 2, F.lit(0.5), F.greatest(1 - r * r, F.lit(0.0))))
