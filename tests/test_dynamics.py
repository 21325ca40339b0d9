"""Moving decompositions and state-space models against plain loops, with chunks far smaller than the series."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from seriesframe.operators import arma, smooth, states


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, slot long, x double")


@pytest.fixture(scope="module")
def cycles():
    """A cycle of 6 that grows, on a bent trend, with gaps; one series without name, one nearly and one wholly empty."""
    rng = random.Random(11)
    rows = []
    for name in ("a", None):
        for slot in range(10, 210):
            x = 0.002 * (slot - 90) ** 2 + slot / 40 * math.sin(slot * math.pi / 3) + rng.gauss(0, 0.3)
            rows.append((name, slot, None if rng.random() < 0.2 or 60 < slot < 75 else x))
    rows += [("one", s, 5.0 if s == 4 else None) for s in range(9)]
    return rows + [("none", s, None) for s in range(9)]


def by_series(rows):
    out = {}
    for k, slot, x in rows:
        out.setdefault(k, {})[slot] = x
    return out


def plain_line(points, at, reach, step=1):
    """Weighted line through {place: value} around one place, by sums written out."""
    s0 = s1 = s2 = t0 = t1 = 0.0
    for j in range(-reach, reach + 1):
        v = points.get(at + j * step)
        if v is not None:
            w = (1 - (abs(j) / (reach + 1)) ** 3) ** 3
            s0, s1, s2, t0, t1 = s0 + w, s1 + w * j, s2 + w * j * j, t0 + w * v, t1 + w * j * v
    if s0 == 0:
        return None
    spread = s0 * s2 - s1 * s1
    return (s2 * t0 - s1 * t1) / spread if spread > 1e-9 * s0 * s2 else t0 / s0


def plain_decomposition(values, period, season, low, trend, rounds):
    lo, hi = min(values), max(values)
    known = {s: v for s, v in values.items() if v is not None}
    level, seasonal = {s: 0.0 for s in values}, {}
    for _ in range(rounds):
        off = {s: v - level[s] for s, v in known.items() if level[s] is not None}
        cycle = {s: plain_line(off, s, season, period) for s in range(lo - period, hi + period + 1)}
        once = lambda points, size, at: [points[s] for s in range(at, at + size)]
        weights = np.convolve(np.convolve(np.ones(period) / period, np.ones(period) / period), np.ones(3) / 3)
        slow = {}
        for s in values:
            near = [(w, c) for w, c in zip(weights, once(cycle, 2 * period + 1, s - period)) if c is not None]
            slow[s] = sum(w * c for w, c in near) / sum(w for w, _ in near) if near else None
        slow = {s: plain_line(slow, s, low) for s in values}
        seasonal = {s: cycle[s] - slow[s] if None not in (cycle[s], slow[s]) else 0.0 for s in values}
        level = {s: plain_line({q: v - seasonal[q] for q, v in known.items()}, s, trend) for s in values}
    return {s: (level[s], seasonal[s]) for s in values}


@pytest.mark.parametrize("size", [1, 4096])
def test_moving_season_equals_plain_loops(spark, cycles, size):
    out = smooth.decompose_local(frame(spark, cycles), ["k"], "slot", "x", 6, season=2, trend=7, low=3, size=size)
    got = {}
    for row in out.collect():
        got.setdefault(row.k, {})[row.slot] = (row.trend, row.seasonal)
        if row.x is not None:
            assert row.remainder == pytest.approx(row.x - row.trend - row.seasonal)
    for k, values in by_series(cycles).items():
        want = plain_decomposition(values, 6, 2, 3, 7, 2)
        assert set(got[k]) == set(want)
        for s, (level, seasonal) in want.items():
            assert got[k][s] == (pytest.approx(level), pytest.approx(seasonal))


def test_season_moves_with_the_series(spark, cycles):
    """The season grows from small to large, which fixed slot means cannot follow."""
    out = smooth.decompose_local(frame(spark, cycles), ["k"], "slot", "x", 6, season=3)
    rows = [r for r in out.collect() if r.k == "a"]
    early = max(abs(r.seasonal) for r in rows if r.slot < 40)
    late = max(abs(r.seasonal) for r in rows if r.slot > 180)
    assert late > 3 * early and late == pytest.approx(200 / 40 * math.sin(math.pi / 3), rel=0.25)


@pytest.mark.parametrize("size", [3, 4096])
def test_local_season_fill(spark, cycles, size):
    out = smooth.impute_local_season(frame(spark, cycles), ["k"], "slot", "x", 6, "y", size, season=3).collect()
    assert len(out) == len(cycles)
    truth = lambda s: 0.002 * (s - 90) ** 2 + s / 40 * math.sin(s * math.pi / 3)
    for row in out:
        if row.x is not None:
            assert row.y == row.x
        elif row.k in ("a", None):
            assert abs(row.y - truth(row.slot)) < 3.0
        else:
            assert row.y == (5.0 if row.k == "one" else None)


def test_fixed_line_and_empty_window():
    y = np.array([1.0, np.nan, 3.0, 4.0, np.nan, np.nan, np.nan, np.nan, 9.0])
    out = smooth.local_line(y, 2)
    assert out[:4] == pytest.approx([1, 2, 3, 4]) and np.isnan(smooth.local_line(y, 1)[6]) and out[8] == 9.0


def plain_smoother(values, kind, q):
    """Sequential filter and its way back for one ratio: levels, slopes, variances over the noise, likelihood terms."""
    f = np.eye(1) if kind == "level" else np.array([[1.0, 1.0], [0.0, 1.0]])
    known = [v for v in values if v is not None]
    m, p = np.zeros(len(f)), np.eye(len(f)) * states.DIFFUSE
    m[0] = sum(known) / len(known)
    before, after, logs, errors = [], [], 0.0, 0.0
    for v in values:
        m, p = f @ m, f @ p @ f.T + np.diag(q)
        before.append((m, p))
        if v is not None:
            s, off = p[0, 0] + 1, v - m[0]
            m, p = m + p[:, 0] / s * off, p - np.outer(p[:, 0], p[0]) / s
            logs, errors = logs + math.log(s), errors + off * off / s
        after.append((m, p))
    out = [after[-1]]
    for (m, p), (m1, p1) in zip(after[-2::-1], before[::-1]):
        e = p @ f.T @ np.linalg.inv(p1)
        out.append((m + e @ (out[-1][0] - m1), p + e @ (out[-1][1] - p1) @ e.T))
    cost = len(known) * math.log(errors / len(known)) + logs
    return out[::-1], cost, errors / len(known)


@pytest.mark.parametrize("size", [1, 7, 64, 4096])
@pytest.mark.parametrize("kind", ["level", "trend"])
def test_states_equal_sequential_smoother(spark, cycles, kind, size):
    ratios = ((0.001,), (0.1,), (3.0,)) if kind == "level" else ((0.01, 0.0), (0.1, 1e-3), (0.5, 0.2))
    out = states.smooth_states(frame(spark, cycles), ["k"], "slot", "x", kind, ratios, size).collect()
    assert len(out) == len(cycles)
    for k, group in by_series(cycles).items():
        got = sorted((r for r in out if r.k == k), key=lambda r: r.slot)
        values = [group[s] for s in sorted(group)]
        if k == "none":
            assert all(r.level is None and r.sigma2 is None and r.level_var is None for r in got)
            continue
        if k == "one":  # a single value fits any ratio perfectly but for rounding
            assert all(r.level == pytest.approx(5.0, abs=1e-3) for r in got)
            continue
        fits = [plain_smoother(values, kind, q) for q in ratios]
        best = min(range(len(fits)), key=lambda i: (fits[i][1], i))
        smoothed, _, sigma2 = fits[best]
        assert {r.ratio for r in got} == {best}
        for row, (m, p) in zip(got, smoothed):
            assert row.level == pytest.approx(m[0], abs=1e-6) and row.sigma2 == pytest.approx(sigma2)
            assert row.level_var == pytest.approx(p[0, 0] * sigma2, rel=1e-5)
            if kind == "trend":
                assert row.slope == pytest.approx(m[1], abs=1e-6)


def test_long_series_in_chunks(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=12_000)) * 0.3 + rng.normal(size=12_000)
    rows = [("w", k, None if k % 7 == 3 or 5_000 < k < 5_600 else float(v)) for k, v in enumerate(x)]
    out = states.smooth_states(frame(spark, rows), ["k"], "slot", "x", size=500).orderBy("slot").collect()
    place = out[0].ratio
    ratio = states.usual_ratios("level")[place][0]
    assert 0.03 < ratio < 0.3  # steps of variance 0.09 under noise of variance 1
    smoothed, _, sigma2 = plain_smoother([r[2] for r in rows], "level", [ratio])
    assert np.allclose([r.level for r in out], [m[0] for m, _ in smoothed], atol=1e-8)
    assert out[0].sigma2 == pytest.approx(sigma2) == pytest.approx(1.0, rel=0.1)


def test_elements_group_in_any_way():
    walk = states.Walk("trend", states.usual_ratios("trend"))
    rng = np.random.default_rng(4)
    y = rng.normal(size=9)
    y[[2, 5]] = np.nan
    whole = states.element(walk, y)
    for cut in range(1, 9):
        parts = states.together(states.element(walk, y[:cut]), states.element(walk, y[cut:]))
        assert all(np.allclose(a, b) for a, b in zip(whole, parts))


def test_states_without_keys_and_fill(spark, cycles):
    rows = [r for r in cycles if r[0] == "a"]
    out = states.impute_states(frame(spark, rows).drop("k"), [], "slot", "x", "y", "trend", size=16).collect()
    assert len(out) == len(rows) and all(r.y == r.x for r in out if r.x is not None) and all(r.y is not None for r in out)


@pytest.fixture(scope="module")
def shocks():
    """An ARMA(2, 1) with a mean, a random walk, and a series too short for any model."""
    rng = np.random.default_rng(5)
    rows = []
    e = rng.normal(size=6_001)
    y = [0.0, 0.0]
    for k in range(2, 6_000):
        y.append(0.5 + 0.6 * y[-1] - 0.3 * y[-2] + e[k] + 0.4 * e[k - 1])
    rows += [("arma", k, None if k % 500 == 7 else float(v)) for k, v in enumerate(y)]
    rows += [(None, k, float(v)) for k, v in enumerate(np.cumsum(rng.normal(size=900)))]
    return rows + [("short", k, float(k % 3)) for k in range(11)]


def plain_orders(values, p, d, q, long):
    """{(p, d, q): (n, intercept, coefficients, sigma2)} by least squares on rows written out."""
    reach = d + q + long
    rows = [k for k in range(reach, len(values)) if None not in values[k - reach : k + 1]]
    out = {}
    for order in range(d + 1):
        def u(k, j):
            return values[k - j] - (values[k - j - 1] if order else 0)

        def fit(response, predictors):
            x = np.column_stack([np.ones(len(rows)), *predictors]) if predictors else np.ones((len(rows), 1))
            b = np.linalg.lstsq(x, response, rcond=None)[0]
            return b, float(((response - x @ b) ** 2).mean())

        past = [np.array([u(k, j) for k in rows]) for j in range(q + long + 1)]
        b, _ = fit(past[0], past[1 : long + 1])
        shock = [past[j] - b[0] - sum(b[i] * past[j + i] for i in range(1, long + 1)) for j in range(q + 1)]
        for i in range(p + 1):
            for j in range(q + 1):
                b, s = fit(past[0], [*past[1 : i + 1], *shock[1 : j + 1]])
                out[i, order, j] = (len(rows), b[0], list(b[1:]), s)
    return out


@pytest.mark.parametrize("size", [16, 4096])
def test_orders_equal_least_squares(spark, shocks, size):
    out = arma.arma_orders(frame(spark, shocks), ["k"], "slot", "x", 2, 1, 2, 5, size).collect()
    for k, group in by_series(shocks).items():
        got = {(r.p, r.d, r.q): r for r in out if r.k == k}
        if k == "short":
            assert len(got) == 18 and all(r.aicc is None for key, r in got.items() if sum(key) > 2)
            continue
        for key, (n, constant, b, sigma2) in plain_orders([group[s] for s in sorted(group)], 2, 1, 2, 5).items():
            row = got[key]
            assert row.n == n and row.sigma2 == pytest.approx(sigma2) and row.intercept == pytest.approx(constant, abs=1e-7)
            assert [*row.ar, *row.ma] == pytest.approx(b, abs=1e-7)
        assert sorted(r.model_rank for r in got.values()) == list(range(1, 19))
        assert min(got.values(), key=lambda r: r.aicc).model_rank == 1
    best = {r.k: r for r in out if r.model_rank == 1}
    assert (best["arma"].p, best["arma"].d) == (2, 0) and best["arma"].ar == pytest.approx([0.6, -0.3], abs=0.1)


def test_models_with_terms_and_errors(spark):
    """Against least squares on rows, plain and with the residuals' autocorrelation taken out step by step."""
    rng = np.random.default_rng(6)
    n = 800
    a, b = rng.normal(size=n), rng.normal(size=n) + 3
    e = np.zeros(n)
    for k in range(1, n):
        e[k] = 0.7 * e[k - 1] + rng.normal()
    y = 2 + 1.5 * a - 0.5 * b + 0.25 * a * b + e
    rows = [("m", k, float(y[k]), float(a[k]), None if k == 99 else float(b[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "k string, slot long, x double, a double, b double")
    terms = {"a": F.col("a"), "b": F.col("b"), "ab": F.col("a") * F.col("b"), "twice": F.col("a") * 2 + 1}
    models = {"none": [], "a": ["a"], "all": ["a", "b", "ab"], "aliased": ["a", "twice"]}
    out = {(r.model, r.errors): r for r in arma.compare_models(df, ["k"], "slot", "x", terms, models, size=50).collect()}
    fine = [k for k in range(1, n) if 99 not in (k, k - 1)]
    now = {"a": a[fine], "b": b[fine], "ab": (a * b)[fine]}
    past = {t: v[[k - 1 for k in fine]] for t, v in (("a", a), ("b", b), ("ab", a * b))}
    y0, y1 = y[fine], y[[k - 1 for k in fine]]
    for name, chosen in models.items():
        chosen = ["a"] if name == "aliased" else chosen
        rho = 0.0
        for errors, rounds in (("iid", 1), ("ar1", 200)):
            for _ in range(rounds):
                x = np.column_stack([np.ones(len(fine)), *[now[t] - rho * past[t] for t in chosen]])
                fit = np.linalg.lstsq(x, y0 - rho * y1, rcond=None)[0]
                rss = float(((y0 - rho * y1 - x @ fit) ** 2).sum())
                left, before = y0 - sum(f * now[t] for f, t in zip(fit[1:], chosen)), y1 - sum(f * past[t] for f, t in zip(fit[1:], chosen))
                used, rho = rho, float(np.cov(left, before)[0, 1] / np.var(before, ddof=1))
            row = out[name, errors]
            assert row.n == len(fine) and row.n_par == len(chosen) + (2 if errors == "iid" else 3)
            assert row.mean_rss == pytest.approx(rss / len(fine)) and row.intercept == pytest.approx(fit[0] / (1 - used))
            assert row.estimates[: len(chosen)] == pytest.approx(list(fit[1:])) and not any(row.estimates[len(chosen) :])
            if errors == "ar1":
                assert row.rho == pytest.approx(used)
            rho = 0.0
    best = next(r for r in out.values() if r.model_rank == 1)
    assert (best.model, best.errors) == ("all", "ar1") and best.rho == pytest.approx(0.7, abs=0.08)
