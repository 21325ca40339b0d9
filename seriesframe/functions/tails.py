"""Tail probabilities of the usual test statistics as column expressions.

Continued fractions and series run as aggregates over a sequence inside the expression, so they work in any plan without Python;
only the studentised range, a double integral, is an Arrow function.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """Work a value out once and use it in several places of an expression."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()])), then)[0]


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 0):
        total = total + c / (x + k)
    t = x + 6.5
    return (x - 0.5) * F.log(t) - t + F.log(total) + 0.5 * math.log(2 * math.pi)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function of x for a, b >= 0.5; null outside of 0 to 1.

    The continued fraction converges fast under (a + 1) / (a + b + 2), and the other side is its mirror image. The number of
    terms follows from the larger parameter.
    """

    def whole(v: Column) -> Column:
        turned = v["x"] > (v["a"] + 1) / (v["a"] + v["b"] + 2)
        p, q = F.when(turned, v["b"]).otherwise(v["a"]), F.when(turned, v["a"]).otherwise(v["b"])
        z = F.when(turned, 1 - v["x"]).otherwise(v["x"])
        return _let({"p": p, "q": q, "z": z, "turned": turned.cast("double")}, ordered)

    def ordered(v: Column) -> Column:
        p, q, z = v["p"], v["q"], v["z"]

        def term(i: Column) -> Column:
            m = F.floor(i / 2)
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(i % 2 == 1, odd).otherwise(m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)))

        # Lentz: c and d are the two running quotients, r their product, h all products before it.
        start = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"), F.lit(1.0).alias("r"))

        def step(s: Column, i: Column) -> Column:
            t = term(i)
            c, d = 1 + t / s["c"], 1 + t * s["d"]
            return F.struct(c.alias("c"), (1 / d).alias("d"), (s["h"] * s["r"]).alias("h"), (c / d).alias("r"))

        many = F.least(120 + 10 * F.sqrt(F.greatest(p, q)), F.lit(2e6)).cast("int")
        fraction = F.aggregate(F.sequence(F.lit(1), many), start, step, lambda s: s["h"] * s["r"])
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(z) + q * F.log(1 - z))
        value = front * fraction / p
        return F.when(v["turned"] == 1, 1 - value).otherwise(value)

    inside = _let({"a": a, "b": b, "x": x}, whole)
    return F.when(x <= 0, F.when(x == 0, F.lit(0.0))).when(x >= 1, F.when(x == 1, F.lit(1.0))).otherwise(inside)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function of x for a >= 0.5: a series under a + 1, a continued fraction above."""

    def whole(v: Column) -> Column:
        a, x = v["a"], v["x"]
        many = F.least(120 + 12 * F.sqrt(a), F.lit(2e6)).cast("int")
        places = F.sequence(F.lit(1), many)
        first = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
        add = lambda s, i: F.struct((s["t"] * x / (a + i)).alias("t"), (s["s"] + s["t"] * x / (a + i)).alias("s"))
        series = F.aggregate(places, first, add, lambda s: s["s"])
        # Lentz for 1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - ...)).
        base = x + 1 - a
        start = F.struct(F.lit(1e300).alias("c"), (1 / base).alias("d"), (1 / base).alias("h"), F.lit(1.0).alias("r"))

        def step(s: Column, i: Column) -> Column:
            t, u = -i * (i - a), base + 2 * i
            return F.struct((u + t / s["c"]).alias("c"), (1 / (u + t * s["d"])).alias("d"), (s["h"] * s["r"]).alias("h"), ((u + t / s["c"]) / (u + t * s["d"])).alias("r"))

        fraction = F.aggregate(places, start, step, lambda s: s["h"] * s["r"])
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        return F.when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return F.when(x <= 0, F.lit(1.0)).otherwise(_let({"a": a, "x": x}, whole))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """Probability of a larger F value."""
    return F.when(f <= 0, F.lit(1.0)).otherwise(incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))


def t_tails(t: Column, df: Column) -> Column:
    """Probability of a t value farther from 0, on both sides together."""
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def chi_square_tail(x: Column, df: Column | int) -> Column:
    """Probability of a larger chi-square value."""
    df = F.lit(float(df)) if isinstance(df, int) else df
    return upper_gamma(df / 2, x / 2)


def t_quantile(tail: float, df: Column) -> Column:
    """The t value that is exceeded on either side with probability ``tail`` in all, by halving an interval.

    In u = df / (df + t^2), which lies between 0 and 1, the probability rises from 0 to 1.
    """

    def halved(v: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            over = incomplete_beta(v["df"] / 2, F.lit(0.5), middle) > tail
            return F.struct(F.when(over, s["low"]).otherwise(middle).alias("low"), F.when(over, middle).otherwise(s["high"]).alias("high"))

        start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda s: F.sqrt(v["df"] * (2 / (s["low"] + s["high"]) - 1)))

    return F.when(df > 0, _let({"df": df}, halved))


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.frompyfunc(math.erfc, 1, 1)(-z / math.sqrt(2)).astype(np.float64)


#: Places of the inner integral and its weights times the normal density; the trapezoid rule is exact to rounding for it.
PLACES = np.linspace(-8.5, 8.5, 137)
WEIGHTS = np.exp(-(PLACES**2) / 2) / math.sqrt(2 * math.pi) * (PLACES[1] - PLACES[0])


def range_tail(q: float, k: float, df: float) -> float:
    """Probability that the range of ``k`` standard normal numbers over an independent spread estimate with ``df`` exceeds ``q``.

    Inside, the chance that all numbers lie within a stretch under the largest; outside, the spread in
    logarithms, in which its density falls off on both sides.
    """
    if not (q == q and k >= 2 and df > 0):
        return math.nan
    if q <= 0:
        return 1.0
    wide = 9.0 / math.sqrt(2 * df)
    u = np.linspace(-max(wide, 22.0 / (df + k - 1)), max(wide, 0.5 * math.log(1 + 60.0 / df)), 161)
    s = np.exp(u)
    log_density = 0.5 * df * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + df * u - df * s * s / 2
    stretch = _normal(PLACES)[None, :] - _normal(PLACES[None, :] - q * s[:, None])
    under = k * (np.clip(stretch, 0, 1) ** (k - 1) @ WEIGHTS)
    # Where the spread is near 0 nothing lies under, so what the grid leaves out there counts as the tail.
    return float(np.clip(1 - (np.exp(log_density) * under).sum() * (u[1] - u[0]), 0, 1))


@lru_cache(maxsize=256)
def range_point(tail: float, k: float, df: float) -> float:
    """The value that the range over the spread exceeds with probability ``tail``."""
    if not (k >= 2 and df > 0):
        return math.nan
    low, high = 0.0, 4.0
    while range_tail(high, k, df) > tail:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if range_tail(middle, k, df) > tail else (low, middle)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def studentised_range_tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """``range_tail`` of columns."""
    return pd.Series([range_tail(*map(float, v)) for v in zip(q, k, df)], dtype="float64")


def studentised_range_point(tail: float) -> Callable[[Column, Column], Column]:
    """``range_point`` of columns k and df for one tail."""

    @F.pandas_udf(DoubleType())
    def point(k: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([range_point(tail, float(a), float(b)) for a, b in zip(k, df)], dtype="float64")

    return point
