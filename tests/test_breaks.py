"""Intervals for the places of level shifts."""

import math
import random

import numpy as np
import pytest

from seriesframe.functions import breakdist
from seriesframe.operators import breaks


def test_reach_by_known_points_and_by_trial():
    # Equal variances: the two-sided 5 % point of the highest place is 11.03, the 10 % point 7.69 (tabled by Bai).
    assert breakdist.reach(0.025, 1.0) == pytest.approx(11.03, abs=0.01) and breakdist.reach(0.05, 1.0) == pytest.approx(7.69, abs=0.01)
    rng = np.random.default_rng(3)
    step, n, ratio = 0.02, 3_000, 2.5
    high = 0
    for _ in range(1_500):
        left = np.cumsum(rng.normal(size=n)) * math.sqrt(step) - step * np.arange(1, n + 1) / 2
        right = np.cumsum(rng.normal(size=n)) * math.sqrt(ratio * step) - step * np.arange(1, n + 1) / 2
        high += right.max() > max(0.0, left.max()) and (right.argmax() + 1) * step > breakdist.reach(0.2, ratio)
    assert high / 1_500 == pytest.approx(0.2, abs=0.035)
    assert breakdist.reach(0.9, 1.0) == 0.0 and math.isfinite(breakdist.reach(0.025, 1e9)) and math.isfinite(breakdist.reach(0.025, 1e-9))


def test_intervals_hold_the_breaks(spark):
    rng = random.Random(4)
    rows, true = [], {"a": (60, 130), None: (90, 150)}
    for k, (x, y) in true.items():
        spread = 1.0 if k else 0.5
        rows += [(k, i, None if i % 17 == 5 else (0.0 if i < x else 4.0 if i < y else 1.0) + rng.gauss(0, spread)) for i in range(200)]
    rows += [("exact", i, float(i >= 30)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    segments = breaks.mean_breakpoints(df, ["k"], "i", "v")
    out = sorted(breaks.break_intervals(df, ["k"], "i", "v", segments).collect(), key=lambda r: (str(r.k), r.segment))
    for k, places in true.items():
        own = [r for r in out if r.k == k]
        points = [i for i, (q, _, v) in enumerate([r for r in rows if r[0] == k]) if v is not None]
        values = [r[2] for r in rows if r[0] == k and r[2] is not None]
        starts = [0, *[r.n_place for r in own], len(values)]
        groups = [np.array(values[a:b]) for a, b in zip(starts, starts[1:])]
        assert len(own) == 2
        for r, p, x, y in zip(own, places, groups, groups[1:]):
            assert r.lower_t <= p - 1 <= r.upper_t and r.lower_t <= r.place_t <= r.upper_t and r.upper_t - r.lower_t < 12
            shift = y.mean() - x.mean()
            low = max(r.n_place - math.ceil(breakdist.reach(0.025, y.var() / x.var()) * x.var() / shift**2), 1)
            high = min(r.n_place + math.ceil(breakdist.reach(0.025, x.var() / y.var()) * y.var() / shift**2), len(values))
            assert (r.n_lower, r.n_upper) == (low, high) and r.shift == pytest.approx(shift)
            assert (r.lower_t, r.place_t, r.upper_t) == (points[low - 1], points[r.n_place - 1], points[high - 1])
    exact = [r for r in out if r.k == "exact"]
    assert [(r.n_lower, r.n_place, r.n_upper) for r in exact] == [(30, 30, 30)]


def test_series_without_breaks(spark):
    df = spark.createDataFrame([("k", i, 1.0 + i % 2) for i in range(40)], "k string, i long, v double")
    segments = breaks.mean_breakpoints(df, ["k"], "i", "v")
    assert breaks.break_intervals(df, ["k"], "i", "v", segments).collect() == []


def plain_segments(x, most, h):
    """Ends of the segments by the full search over all pairs of places."""
    n = len(x)
    x = np.array(x) - np.mean(x)
    s1, s2 = np.concatenate([[0], x.cumsum()]), np.concatenate([[0], (x * x).cumsum()])
    shortest = max(math.floor(n * h), 2)
    best, origin = [s2 - s1 * s1 / np.maximum(np.arange(n + 1), 1)], [None]
    for m in range(1, most + 1):
        now, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for i in range(shortest * (m + 1), n + 1):
            j = np.arange(shortest * m, i - shortest + 1)
            cost = best[-1][j] + (s2[i] - s2[j]) - (s1[i] - s1[j]) ** 2 / (i - j)
            now[i], back[i] = cost.min(), j[cost.argmin()]
        best.append(now)
        origin.append(back)
    fits = [n * math.log(max(b[n], 2.2250738585072014e-308)) + math.log(n) * 2 * (m + 1) for m, b in enumerate(best) if np.isfinite(b[n])]
    m, ends = int(np.argmin(fits)), [n]
    for k in range(m, 0, -1):
        ends.append(int(origin[k][ends[-1]]))
    return ends[::-1]


@pytest.mark.parametrize(("block", "span"), [(1_000, 32), (6, 2), (9, 3)])
def test_pruned_search_equals_the_full_one(spark, monkeypatch, block, span):
    monkeypatch.setattr(breaks, "BLOCK", block)
    monkeypatch.setattr(breaks, "SPAN", span)
    rng = random.Random(21)
    series = {
        "noise": [rng.gauss(0, 1) for _ in range(150)],
        "shifts": [(0, 3, 1, 5, 2)[k // 30] + rng.gauss(0, 1) for k in range(150)],
        "walk": np.cumsum([rng.gauss(0, 1) for _ in range(140)]).tolist(),
        "steps": [float(rng.randint(0, 2)) for _ in range(120)],
        "constant": [4.0] * 60,
        "cycle": [math.sin(k / 9) for k in range(130)],
    }
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    out = {}
    for r in breaks.mean_breakpoints(df, ["k"], "i", "v", max_breaks=3, h=0.06).orderBy("k", "segment").collect():
        out.setdefault(r.k, []).append(r.to_t + 1)
    for k, x in series.items():
        assert out[k] == plain_segments(x, 3, 0.06), k


def test_contenders_hold_every_best_place():
    rng = np.random.default_rng(22)
    for kind in range(4):
        x = rng.normal(size=900) + (np.arange(900) // 220 * kind)
        x = np.round(x) if kind == 3 else x
        s1, s2 = np.concatenate([[0], x.cumsum()]), np.concatenate([[0], (x * x).cumsum()])
        i = np.arange(1, 600)
        best = s2[i] - s1[i] ** 2 / i
        kept = breaks.contenders(i, s1[i], s2[i], best)
        assert kept.sum() < 60
        for end in range(602, 901, 7):
            cost = best + (s2[end] - s2[i]) - (s1[end] - s1[i]) ** 2 / (end - i)
            assert cost[kept].min() == cost.min()
