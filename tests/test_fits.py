"""Non-linear fits against plain damped least squares, group by group."""

import math

import numpy as np
import pytest

from seriesframe.operators import nonlinear

VALUE = {
    "power": lambda x, p: p[0] * x ** p[1],
    "asymptote": lambda x, p: p[0] + (p[1] - p[0]) * np.exp(-np.exp(p[2]) * x),
    "plateau": lambda x, p: p[0] + p[1] * np.exp(-p[2] * (x - 4.0)),
}
CURVE = {"power": nonlinear.POWER, "asymptote": nonlinear.ASYMPTOTE, "plateau": nonlinear.plateau(4.0)}
TRUE = {"power": (44.5, -1.3), "asymptote": (3.0, 20.0, -0.7), "plateau": (2.0, 5.0, 0.4)}


def plain(kind, x, y, p):
    """Gauss-Newton with numeric derivatives and halved steps, from the true parameters."""
    f, p = VALUE[kind], np.array(p, float)
    for _ in range(200):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.column_stack([(f(x, p + d) - f(x, p - d)) / (2 * d.sum()) for d in np.diag(h)])
        step = np.linalg.lstsq(j, y - f(x, p), rcond=None)[0]
        while ((y - f(x, p + step)) ** 2).sum() > ((y - f(x, p)) ** 2).sum() and np.abs(step).max() > 1e-14:
            step = step / 2
        p = p + step
    se = np.sqrt(np.diag(np.linalg.inv(j.T @ j)) * ((y - f(x, p)) ** 2).sum() / (len(x) - len(p)))
    return p, ((y - f(x, p)) ** 2).sum(), se


@pytest.mark.parametrize("kind", sorted(CURVE))
def test_curves_equal_plain_fits(spark, kind):
    rng = np.random.default_rng(2)
    rows, data = [], {}
    for name in ("a", "b", None):
        x = np.repeat(rng.uniform(0.5, 9, size=60).round(2), 3)  # repeated places
        y = VALUE[kind](x, TRUE[kind]) + rng.normal(size=180) * 0.3
        data[name] = (x, y)
        rows += [(name, float(u), float(v)) for u, v in zip(x, y)]
    rows += [("a", None, 1.0), ("b", 1.0, None), ("nothing", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").selectExpr("*", "1 as n", "2 as sse", "3 as start").repartition(3)
    out = {row.k: row for row in nonlinear.fit_curve(df, ["k"], "y", "x", CURVE[kind]).collect()}
    assert set(out) == set(data)
    for k, (x, y) in data.items():
        p, sse, se = plain(kind, x, y, TRUE[kind])
        row = out[k]
        assert row.converged and row.n == 180 and row.steps < 30
        assert [row[c] for c in CURVE[kind].names] == pytest.approx(list(p), rel=1e-6)
        assert row.sse == pytest.approx(sse, rel=1e-9)
        assert [row[f"se_{c}"] for c in CURVE[kind].names] == pytest.approx(list(se), rel=1e-4)
        like = lambda v: -len(x) / 2 * (math.log(2 * math.pi * v / len(x)) + 1)
        null = like(((y - y.mean()) ** 2).sum())
        assert row.r2_max == pytest.approx((1 - math.exp(2 / len(x) * (null - like(sse)))) / (1 - math.exp(2 / len(x) * null)))


def test_without_keys_and_bounded_steps(spark):
    x = np.linspace(1, 9, 40)
    rows = [(float(u), float(v)) for u, v in zip(x, VALUE["power"](x, (5.0, 0.5)))]
    df = spark.createDataFrame(rows, "x double, y double")
    row = nonlinear.fit_curve(df, [], "y", "x", nonlinear.POWER).first()
    assert (row.a, row.b) == (pytest.approx(5.0), pytest.approx(0.5)) and row.converged
    few = nonlinear.fit_curve(df, [], "y", "x", nonlinear.ASYMPTOTE, steps=2).first()
    assert few.steps == 2 and not few.converged and few.sse is not None


def test_curves_that_points_do_not_determine(spark):
    """One point, one place, a straight line, negative and zero places: an answer, never an error."""
    rows = [("point", 2.0, 3.0)] + [("place", 2.0, float(k)) for k in range(5)]
    rows += [("line", float(k), 2.0 * k) for k in range(1, 9)] + [("negative", -float(k), 1.0) for k in range(6)]
    rows += [("zero", float(k), 8.0 - k) for k in range(6)] + [("flat", float(k), 4.0) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for curve in CURVE.values():
        out = {r.k: r for r in nonlinear.fit_curve(df, ["k"], "y", "x", curve, steps=6).collect()}
        assert set(out) == {"point", "place", "line", "negative", "zero", "flat"}
        assert all(r.steps <= 6 for r in out.values())
        assert out["flat"].sse == pytest.approx(0.0, abs=1e-9) and out["place"].sse == pytest.approx(10.0)
    assert nonlinear.fit_curve(df.limit(0), ["k"], "y", "x", nonlinear.POWER).collect() == []
