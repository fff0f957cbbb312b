"""Statistics of experiments: t values, trends, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_one_sample(x: Column, mean: float) -> Column:
    return (F.avg(x) - mean) / (F.stddev_samp(x) / F.sqrt(F.count(x)))


def t_paired(a: Column, b: Column) -> Column:
    return t_one_sample(a - b, 0.0)


def t_independent(x: Column, first: Column) -> Column:
    """Equal variances; ``first`` tells the first group's rows."""
    a, b = F.when(first, x), F.when(~first, x)
    na, nb = F.count(a), F.count(b)
    pooled = ((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2)
    return (F.avg(a) - F.avg(b)) / F.sqrt(pooled * (1.0 / na + 1.0 / nb))


def p_value(t: float, df: float) -> float:
    """Two-sided, by the continued fraction of the incomplete beta function; for the one row that a test gives."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, f = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)), 0.0
    f = d
    for m in range(1, 300):
        n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + n * d), 1 + n / c
        f *= d * c
        n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + n * d), 1 + n / c
        step = d * c
        f *= step
        if abs(step - 1) < 1e-12:
            break
    return 1 - front * f if flip else front * f
