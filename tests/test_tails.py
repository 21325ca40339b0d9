"""Tail probabilities against closed forms, tabled values and plain numeric integrals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesframe.functions import tails
from seriesframe.operators import models, signal


def column(spark, rows, shape, expression):
    rows = [(k, *map(float, r)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in shape)).withColumn("p", expression)
    return [r.p for r in df.orderBy("k").collect()]


def simpson(f, low, high, n=20_000):
    x = np.linspace(low, high, n + 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((f(x) * w).sum() * (high - low) / n / 3)


def test_log_gamma(spark):
    x = [0.5, 1, 1.5, 2, 3.7, 10, 99.5, 4e3, 5e6]
    got = column(spark, [(v,) for v in x], ["x"], tails.log_gamma(F.col("x")))
    assert got == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-13)


def test_t_closed_forms(spark):
    ts = [0.01, 0.5, 1.0, 2.2, 7.0, 40.0]
    one = column(spark, [(t,) for t in ts], ["t"], tails.t_tails(F.col("t"), F.lit(1.0)))
    assert one == pytest.approx([1 - 2 / math.pi * math.atan(t) for t in ts], rel=1e-9)
    two = column(spark, [(t,) for t in ts], ["t"], tails.t_tails(F.col("t"), F.lit(2.0)))
    assert two == pytest.approx([1 - t / math.sqrt(2 + t * t) for t in ts], rel=1e-8)


@pytest.mark.parametrize("df", [3, 10, 57, 1_000, 60_000])
def test_t_by_integral(spark, df):
    ts = [0.3, 1.96, 3.1]
    log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    want = [1 - 2 * simpson(lambda x: np.exp(log - (df + 1) / 2 * np.log1p(x * x / df)), 0, t) for t in ts]
    assert column(spark, [(t,) for t in ts], ["t"], tails.t_tails(F.col("t"), F.lit(float(df)))) == pytest.approx(want, abs=1e-9)


def test_f_closed_forms_and_table(spark):
    # With two degrees of freedom above, the tail is (1 + 2 f / d) ** (-d / 2).
    rows = [(f, d) for f in (0.1, 1.0, 4.5, 20.0) for d in (1, 7, 100, 50_000)]
    got = column(spark, rows, ["f", "d"], tails.f_tail(F.col("f"), F.lit(2.0), F.col("d")))
    assert got == pytest.approx([(1 + 2 * f / d) ** (-d / 2) for f, d in rows], rel=1e-8)
    # Points of the F distribution that are exceeded with probability 0.05.
    table = [(4.9646027, 1, 10), (3.3258345, 5, 10), (161.4476387, 1, 1), (2.3719, 4, 1e6)]
    got = column(spark, table, ["f", "a", "b"], tails.f_tail(F.col("f"), F.col("a"), F.col("b")))
    assert got == pytest.approx([0.05] * len(table), abs=1e-5)


def test_chi_square_closed_forms(spark):
    xs = [0.001, 0.5, 1.0, 3.841458820694124, 6.0, 30.0, 200.0]
    assert column(spark, [(x,) for x in xs], ["x"], tails.chi_square_tail(F.col("x"), 2)) == pytest.approx([math.exp(-x / 2) for x in xs], rel=1e-9)
    assert column(spark, [(x,) for x in xs], ["x"], tails.chi_square_tail(F.col("x"), 1)) == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in xs], rel=1e-8)
    poisson = lambda x, m: sum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(m))
    for m in (5, 400):
        at = [m, 1.9 * m, 2.0 * m, 2.2 * m]
        assert column(spark, [(x,) for x in at], ["x"], tails.chi_square_tail(F.col("x"), 2 * m)) == pytest.approx([poisson(x, m) for x in at], abs=1e-10)


def test_edges(spark):
    beta = column(spark, [(-1,), (0,), (1,), (2,)], ["x"], tails.incomplete_beta(F.lit(2.0), F.lit(3.0), F.col("x")))
    assert beta == [None, 0.0, 1.0, None]
    assert column(spark, [(0,), (-3,)], ["f"], tails.f_tail(F.col("f"), F.lit(2.0), F.lit(9.0))) == [1.0, 1.0]
    assert column(spark, [(0,)], ["x"], tails.chi_square_tail(F.col("x"), 3)) == [1.0]
    half = spark.range(1).select(tails.t_quantile(0.05, F.lit(None).cast("double")).alias("q"), tails.t_tails(F.lit(None).cast("double"), F.lit(3.0)).alias("p")).first()
    assert (half.q, half.p) == (None, None)


def test_t_quantiles(spark):
    # Two-sided 5 % points of the t distribution.
    table = {1: 12.706204736, 2: 4.302652730, 5: 2.570581836, 28: 2.048407142, 1_000: 1.962339081}
    got = column(spark, [(d,) for d in table], ["d"], tails.t_quantile(0.05, F.col("d")))
    assert got == pytest.approx(list(table.values()), rel=1e-8)


def test_studentised_range():
    # Two means: the range is sqrt(2) |t|; df 1 and 2 have closed forms.
    for q in (0.5, 2.0, 9.0, 30.0):
        t = q / math.sqrt(2)
        assert tails.range_tail(q, 2, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-6)
        assert tails.range_tail(q, 2, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-7)
    # Tabled points that are exceeded with probability 0.05.
    for k, df, q in ((3, 10, 3.876777), (4, 20, 3.958293), (5, 30, 4.102079), (3, 20, 3.577935)):
        assert tails.range_tail(q, k, df) == pytest.approx(0.05, abs=1e-6)
        assert tails.range_point(0.05, k, df) == pytest.approx(q, abs=1e-5)
    # Against the double integral on other grids.
    phi = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = lambda z: 0.5 * np.frompyfunc(math.erfc, 1, 1)(-z / math.sqrt(2)).astype(float)
    for k, df, q in ((5, 9, 3.2), (8, 400, 4.4), (3, 10_000, 2.0)):
        inner = lambda w: simpson(lambda z: k * phi(z) * (cdf(z) - cdf(z - w)) ** (k - 1), -9, 9, 600)
        density = lambda s: 2 * (df / 2) ** (df / 2) / math.gamma(df / 2) * s ** (df - 1) * math.exp(-df * s * s / 2) if df < 100 else math.exp(
            df / 2 * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + (df - 1) * math.log(s) - df * s * s / 2)
        low, high = max(1e-6, 1 - 7 / math.sqrt(df)), 1 + 8 / math.sqrt(df)
        under = simpson(np.vectorize(lambda s: density(s) * inner(q * s)), low, high, 160)
        assert tails.range_tail(q, k, df) == pytest.approx(1 - under, abs=1e-6)
    assert tails.range_tail(0.0, 3, 5) == 1.0 and math.isnan(tails.range_tail(1.0, 1, 5)) and math.isnan(tails.range_point(0.05, 3, 0))


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(k), float(m + rng.normal())) for g, m, n in (("a", 0.0, 12), ("b", 0.4, 20), ("c", 2.0, 9)) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (None, 1.0, 3.0), ("a", 2.0, None)], "g string, x double, y double")


def test_group_tests(spark, three):
    rows, df = three
    f = models.anova_test(df, "y", "g").first()
    assert f.p_value == pytest.approx((1 + 2 * f.f_value / 38) ** -19, rel=1e-8) and (f.df_between, f.df_within) == (2, 38)
    pairs = {(r.group_a, r.group_b): r for r in models.tukey_test(df, "y", "g").collect()}
    y = {g: np.array([v for h, _, v in rows if h == g]) for g in "abc"}
    ms = sum(((v - v.mean()) ** 2).sum() for v in y.values()) / 38
    assert set(pairs) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), row in pairs.items():
        se = math.sqrt(ms / 2 * (1 / len(y[a]) + 1 / len(y[b])))
        diff = y[b].mean() - y[a].mean()
        assert row.diff == pytest.approx(diff) and row.p_value == pytest.approx(tails.range_tail(abs(diff) / se, 3, 38), abs=1e-9)
        assert (row.lower, row.upper) == pytest.approx((diff - 3.449 * se, diff + 3.449 * se), abs=2e-3)


def test_line_tests_and_forecast_bounds(spark, three):
    rows, df = three
    for r in models.ols_test(df.where("g is not null"), ["g"], "y", "x").collect():
        x, y = (np.array([row[k] for row in rows if row[0] == r.g]) for k in (1, 2))
        z = np.column_stack([x, np.ones(len(x))])
        b, rss = np.linalg.lstsq(z, y, rcond=None)[:2]
        se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * rss[0] / (len(x) - 2))
        assert [r.slope, r.intercept, r.se_slope, r.se_intercept] == pytest.approx([*b, *se])
        assert r.t_slope == pytest.approx(b[0] / se[0]) and 0 < r.p_slope < 1
    df = df.withColumn("x", F.col("x").cast("long"))
    out = signal.forecast_bounds(df.where("g is not null"), ["g"], "x", "y", 3).collect()
    assert len(out) == 9
    for r in out:
        x, y = (np.array([row[k] for row in rows if row[0] == r.g]) for k in (1, 2))
        s = math.sqrt(((y - r.intercept - r.slope * x) ** 2).sum() / (len(x) - 2) * (1 + 1 / len(x) + (r.idx - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
        t = {12: 2.228139, 20: 2.100922, 9: 2.364624}[len(x)]  # two-sided 5 % points with two degrees less
        assert (r.lower_95, r.upper_95) == pytest.approx((r.forecast - t * s, r.forecast + t * s), rel=1e-5)
        assert r.lower_95 < r.lower_80 < r.forecast < r.upper_80 < r.upper_95
    assert signal.forecast_bounds(df.where("x < 2 and g = 'a'"), ["g"], "x", "y", 1).first().upper_95 is None


def test_zero_test_probability(spark):
    df = spark.createDataFrame([("a", k % 4 * (k % 3)) for k in range(60)], "g string, n long")
    row = models.zero_test_p(df, ["g"], "n").first()
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(row.score / 2)), rel=1e-8)


def test_arrow_function_of_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"q": [3.876777, 1.0], "k": [3.0, 2.0], "d": [10.0, 1.0]}))
    got = [r.p for r in df.select(tails.studentised_range_tail("q", "k", "d").alias("p")).collect()]
    assert got == pytest.approx([0.05, 1 - 2 / math.pi * math.atan(1 / math.sqrt(2))], abs=1e-6)
