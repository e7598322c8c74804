"""Tails of the normal and chi-square distributions as column expressions.

Both are the regularized upper incomplete gamma function: its series where x is small against
a, else its continued fraction (Lentz), each a fold over a fixed number of terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 300


def log_gamma(a: Column) -> Column:
    """Stirling's series at a + 8, and the recurrence back to a; a over 0."""
    x = a + 8
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    for i in range(8):
        series = series - F.log(a + i)
    return series


def gamma_upper(a: Column, x: Column) -> Column:
    """Q(a, x), for a over 0; 1 where x is not over 0; null where either is."""
    a, x = a.cast("double"), x.cast("double")
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * x / (a + i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(steps, F.struct((1 / a).alias("term"), (1 / a).alias("sum")), add, lambda s: s["sum"])
    tiny = F.lit(1e-300)
    away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def turn(s: Column, i: Column) -> Column:
        up = i * (a - i)
        b = x + 1 - a + 2 * i
        d = 1 / away(up * s["d"] + b)
        c = away(b + up / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    first = 1 / away(x + 1 - a)
    fraction = F.aggregate(steps, F.struct((1 / tiny).alias("c"), first.alias("d"), first.alias("h")), turn, lambda s: s["h"])
    return F.when(x.isNull() | a.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def normal_tails(z: Column) -> Column:
    """Two-sided p-value of a standard normal score."""
    return gamma_upper(F.lit(0.5), z * z / 2)


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution."""
    return gamma_upper(df / F.lit(2.0), x / 2)
