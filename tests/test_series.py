"""Series operators against brute force, with chunks far smaller than the series."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesframe.operators import breaks, gaps, impute, intervals, median, scan, signal
from seriesframe.operators.running import crossing, cumulative_share, find_peaks, running_total


@pytest.fixture(scope="module")
def gappy():
    """Leading, inner and trailing nulls, one series all null, one without name."""
    rng = random.Random(7)
    out = []
    for name in ("a", "b", None):
        for slot in range(57):
            hole = slot < 3 or slot > 50 or 20 <= slot < 33 or rng.random() < 0.3
            out.append((name, slot, None if hole else round(rng.uniform(0, 50), 2)))
    return out + [("empty", s, None) for s in range(9)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, slot long, x double")


def by_key(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, {})[r.slot] = tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
    return out


@pytest.mark.parametrize("size", [4, 4096])
def test_linear_fill(spark, gappy, size):
    out = by_key(impute.impute_linear(frame(spark, gappy), ["k"], "slot", "x", "y", size), "y")
    for k, group in itertools.groupby(gappy, key=lambda r: r[0]):
        s = pd.Series({slot: x for _, slot, x in group}, dtype=float)
        want = s.interpolate(limit_direction="both")
        got = pd.Series(out[k], dtype=float).sort_index()
        assert np.allclose(got, want, equal_nan=True), k


@pytest.mark.parametrize("size", [4, 4096])
def test_fill_down(spark, gappy, size):
    out = by_key(scan.fill_down(frame(spark, gappy), ["k"], "slot", ["x"], size), "x")
    for k, group in itertools.groupby(gappy, key=lambda r: r[0]):
        want = pd.Series({slot: x for _, slot, x in group}, dtype=float).ffill()
        assert np.allclose(pd.Series(out[k], dtype=float).sort_index(), want, equal_nan=True)


def test_filling_keeps_observed_values(spark, gappy):
    df = frame(spark, gappy)
    for filled in (
        impute.impute_mean(df, ["k"], "x", "y"),
        impute.impute_median(df, ["k"], "x", "y"),
        impute.impute_seasonal(df, ["k"], "slot", "x", 6, "y", 5),
        impute.impute_regression(df, ["k"], "x", "slot", "y"),
    ):
        assert filled.count() == len(gappy)
        assert filled.where("x is not null and (y is null or x <> y)").count() == 0
        assert filled.where("x is null and y is null and not (k <=> 'empty')").count() == 0


def test_gap_statistics(spark, gappy):
    runs = gaps.gap_runs(frame(spark, gappy), ["k"], "slot", "x", 4)
    got = sorted([(str(r.k), r.gap_start, r.gap_end, r.gap_size) for r in runs.collect()])
    want = []
    for k, group in itertools.groupby(gappy, key=lambda r: r[0]):
        for hole, run in itertools.groupby(group, key=lambda r: r[2] is None):
            run = list(run)
            if hole:
                want.append((str(k), run[0][1], run[-1][1], len(run)))
    assert got == sorted(want)
    stats = {r.k: r for r in gaps.gap_stats(frame(spark, gappy), ["k"], "slot", "x", 4).collect()}
    assert stats["empty"].longest_gap == 9 and stats["empty"].null_share == 1.0
    whole = gaps.gap_stats(frame(spark, [r for r in gappy if r[0] == "a"]).drop("k"), [], "slot", "x", 4).first()
    assert whole.n_gaps == stats["a"].n_gaps and whole.n_null == stats["a"].n_null


def test_null_share_bins_have_ntile_sizes(spark, gappy):
    out = gaps.gap_bins(frame(spark, gappy), ["k"], "slot", "x", 20)
    sizes = [r.n_slots for r in out.where("k = 'a'").orderBy("bin").collect()]
    assert sizes == [3] * 17 + [2] * 3
    assert out.where("k = 'empty'").count() == 9


def test_median_is_exact(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.randrange(9)), 1) for _ in range(4001)] + [("tie", 2.0, 1)] * 40
    rows += [("even", float(v), 1) for v in (1, 2, 10, 20)] + [("two", 5.0, 1), ("two", 8.0, 1), (None, 4.0, 1), ("none", None, 1)]
    rows += [("wide", rng.gauss(0, 1e6), 1) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double, one int")
    got = {r.k: r["median"] for r in median.grouped_median(df, ["k"], "x").collect()}
    want = pd.DataFrame(rows, columns=["k", "x", "one"]).dropna(subset=["x"]).groupby("k", dropna=False)["x"].median()
    assert {k: v for k, v in got.items()} == {(None if isinstance(k, float) else k): v for k, v in want.items()}


def repair(spans, gap=1):
    """Sequential rule, one interval after the other."""
    out, last = [], None
    for s, e in sorted(spans):
        pushed = last is not None and s <= last
        first = max(s, last) if pushed else s
        if pushed:
            out[-1][1] = last - gap
        begin = first + gap * pushed
        out.append([begin, max(begin, first + e - s)])
        last = first + max(e - s, 2 * gap)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_overlap_repair_follows_the_sequential_rule(spark, parts):
    rng, t0 = random.Random(3), dt.datetime(2017, 4, 18)
    units = {u: [] for u in ("hot", "b", "c")}
    for u, n in (("hot", 120), ("b", 9), ("c", 1)):
        seen = set()
        while len(seen) < n:
            seen.add(rng.randrange(0, 1500))
        units[u] = [(m * 60, m * 60 + rng.choice([0, 1, *[rng.randrange(5, 30) * 60] * 4])) for m in sorted(seen)]
    rows, at = [], lambda s: t0 + dt.timedelta(seconds=s)
    for u, spans in units.items():
        rows += [(u, i, at(s), at(e)) for i, (s, e) in enumerate(spans)]
    df = spark.createDataFrame(rows, "u string, id int, s timestamp_ntz, e timestamp_ntz")
    out = intervals.resolve_overlaps(df, "s", "e", ["u"], "id", parts=parts).collect()
    for u, spans in units.items():
        got = [(r.start_adj, r.end_adj) for r in sorted(out, key=lambda r: r.id) if r.u == u]
        assert got == [(at(a), at(b)) for a, b in repair(spans)]
        assert all(x[1] < y[0] for x, y in zip(got, got[1:])) and all(a <= b for a, b in got)


def test_overlap_of_two_minutes_and_touching_pair(spark):
    t = lambda h, m, s=0: dt.datetime(2017, 4, 18, h, m, s)
    rows = [("b6", 1, t(9, 12), t(9, 27)), ("b6", 2, t(9, 25), t(9, 40)), ("b2", 3, t(7, 0), t(7, 15)), ("b2", 4, t(7, 15), t(7, 30))]
    df = spark.createDataFrame(rows, "u string, id int, s timestamp_ntz, e timestamp_ntz")
    out = {r.id: (r.start_adj, r.end_adj) for r in intervals.resolve_overlaps(df, "s", "e", ["u"], "id").collect()}
    assert out[1] == (t(9, 12), t(9, 26, 59)) and out[2] == (t(9, 27, 1), t(9, 42))
    assert out[3] == (t(7, 0), t(7, 14, 59)) and out[4] == (t(7, 15, 1), t(7, 30))


@pytest.mark.parametrize("parts", [1, 6])
def test_pmm_draws_from_the_nearest_donors(spark, parts):
    rng = random.Random(5)
    rows = [("a", i, float(rng.randrange(12)), None if rng.random() < 0.4 else round(rng.uniform(0, 9), 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, id long, z double, y double")
    out = impute.impute_pmm(df, ["k"], "y", "z", "id", k=5, m=3, parts=parts)
    got = out.collect()
    assert len(got) == 450 and all(r.filled is not None for r in got)
    seen = [(r[2], r[3]) for r in rows if r[3] is not None]
    slope, icept = np.polyfit([s[0] for s in seen], [s[1] for s in seen], 1)
    donors = [(icept + slope * z, y) for z, y in seen]
    for r in got:
        if r.y is not None:
            assert r.filled == r.y
            continue
        far = sorted(abs(p - (icept + slope * r.z)) for p, _ in donors)[4]
        assert any(y == r.filled and abs(p - (icept + slope * r.z)) <= far + 1e-8 for p, y in donors)
    again = {(r.id, r.m): r.filled for r in impute.impute_pmm(df, ["k"], "y", "z", "id", k=5, m=3, parts=3).collect()}
    assert again == {(r.id, r.m): r.filled for r in got}


def test_noise_is_seeded_and_centred(spark):
    rows = [("a", i, float(i % 10), None if i % 2 else float(i % 10) * 2 + (i % 7) - 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id long, z double, y double")
    out = impute.impute_norm(df, ["k"], "y", "z", "id", m=2, seed=4)
    stats = out.where("y is null").agg(F.avg(F.col("filled") - 2 * F.col("z")), F.stddev("filled")).first()
    assert abs(stats[0]) < 0.3 and stats[1] > 1
    same = impute.impute_norm(df, ["k"], "y", "z", "id", m=2, seed=4).agg(F.sum("filled")).first()[0]
    assert math.isclose(same, out.agg(F.sum("filled")).first()[0], rel_tol=1e-12)


def test_drawn_lines_differ_between_copies(spark):
    rows = [("a", i, float(i % 10), None if i % 2 else float(i % 10) * 2 + (i % 7) - 3) for i in range(2000)]
    rows += [("tiny", 0, 1.0, 2.0), ("tiny", 1, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, id long, z double, y double")
    out = impute.impute_norm_drawn(df, ["k"], "y", "z", "id", m=40, seed=4)
    per_copy = out.where("y is null and k = 'a'").groupBy("m").agg(F.avg(F.col("filled") - 2 * F.col("z")).alias("d")).toPandas()["d"]
    assert len(per_copy) == 40 and abs(per_copy.mean()) < 0.1
    # 1,000 observed and 1,000 drawn rows of standard deviation 2: the mean moves by the level's error and the noise.
    assert 0.05 < per_copy.std() < 0.14
    assert out.where("k = 'tiny' and y is null and filled is null").count() == 40


def brute_breaks(x, max_breaks, h=0.15):
    n, short = len(x), max(int(len(x) * h), 2)
    rss = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    best = None
    for m in range(max_breaks + 1):
        for cuts in itertools.combinations(range(1, n), m):
            edges = [0, *cuts, n]
            if min(b - a for a, b in zip(edges, edges[1:])) < short:
                continue
            total = sum(rss(a, b) for a, b in zip(edges, edges[1:]))
            bic = n * np.log(total) + np.log(n) * 2 * (m + 1)
            if best is None or bic < best[0] - 1e-9:
                best = (bic, list(cuts))
    return best[1]


def test_breaks_match_brute_force(spark):
    rng = np.random.default_rng(2)
    series = {
        "flat": rng.normal(0, 1, 26),
        "one": np.r_[rng.normal(0, 1, 12), rng.normal(6, 1, 14)],
        "three": np.r_[rng.normal(0, 1, 7), rng.normal(9, 1, 6), rng.normal(-5, 1, 8), rng.normal(4, 1, 7)],
    }
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("flat", 99, None)]
    out = breaks.mean_breakpoints(frame(spark, rows), ["k"], "slot", "x", max_breaks=3)
    for k, x in series.items():
        got = sorted((r.segment, r.from_t, r.n_points) for r in out.where(F.col("k") == k).collect())
        assert [g[1] for g in got][1:] == brute_breaks(x, 3)
        assert sum(g[2] for g in got) == len(x)
    placed = breaks.assign_segments(frame(spark, rows), out, ["k"], F.col("slot"))
    assert placed.where("k = 'one'").groupBy("segment").count().count() == 2
    assert placed.count() == len(rows)


def test_breaks_of_a_long_series_and_of_four_points(spark):
    n = 20_500
    level = F.when(F.col("id") < 8_000, 0.0).when(F.col("id") < 14_000, 5.0).otherwise(-2.0)
    noise = (F.pmod(F.xxhash64("id"), F.lit(1_000)) / 1_000).cast("double")
    long = spark.range(n).select(F.lit("long").alias("k"), F.col("id").alias("slot"), (level + noise).alias("x"))
    short = frame(spark, [("four", i, v) for i, v in enumerate([0.0, 0.1, 9.0, 9.1])] + [("two", 0, 1.0), ("two", 1, 5.0)])
    out = breaks.mean_breakpoints(long.unionByName(short.select("k", "slot", "x")), ["k"], "slot", "x", max_breaks=2)
    got = {}
    for r in out.orderBy("k", "segment").collect():
        got.setdefault(r.k, []).append((r.from_t, r.to_t, r.n_points))
    assert got == {
        "long": [(0, 7_999, 8_000), (8_000, 13_999, 6_000), (14_000, n - 1, 6_500)],
        "four": [(0, 1, 2), (2, 3, 2)],
        "two": [(0, 1, 2)],
    }


@pytest.mark.parametrize("size", [5, 4096])
def test_autocorrelation_and_ar1_over_chunk_borders(spark, size):
    x = np.random.default_rng(4).normal(0, 1, 61).cumsum()
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)])
    d = x - x.mean()
    acf = {r.lag: r.acf for r in signal.autocorrelation(df, ["k"], "slot", "x", 7, size).collect()}
    for k in range(1, 8):
        assert acf[k] == pytest.approx((d[k:] * d[:-k]).sum() / (d * d).sum())
    fit = signal.ar1_fit(df, ["k"], "slot", "x", size).first()
    assert fit.phi == pytest.approx(np.polyfit(x[:-1], x[1:], 1)[0]) and fit.n_pairs == 60


@pytest.mark.parametrize("period,size", [(7, 5), (6, 5), (6, 4096)])
def test_decomposition(spark, period, size):
    n = 40
    season = np.arange(period) - np.mean(np.arange(period))
    x = 3 + 0.5 * np.arange(n) + season[np.arange(n) % period]
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)])
    out = by_key(signal.decompose_additive(df, ["k"], "slot", "x", period, size), "trend", "seasonal", "remainder")["a"]
    half = period // 2
    for i in range(n):
        trend, seasonal, rest = out[i]
        assert (trend is None) == (i < half or i >= n - half)
        if trend is not None:
            assert trend == pytest.approx(3 + 0.5 * i) and seasonal == pytest.approx(season[i % period])
            assert rest == pytest.approx(0, abs=1e-9)


def test_curves_end_at_one_and_cross_once(spark):
    day = lambda i: dt.date(2017, 4, 3) + dt.timedelta(days=i)
    rows = [("a", day(i), v) for i, v in enumerate([0.0, 1.0, 0.0, 2.0, 1.0])] + [("b", day(0), 4.0)]
    df = spark.createDataFrame(rows, "k string, date date, n double")
    curve = cumulative_share(df, "date", "n", ["k"])
    assert all(r[0] == 1.0 for r in curve.groupBy("k").agg(F.max("cum_share")).select("max(cum_share)").collect())
    half = {r.k: r for r in crossing(curve, "date", "cum_share", 0.5, ["k"]).collect()}
    assert half["a"].cross_date == day(3)
    assert half["a"].cross_day == pytest.approx((day(2) - dt.date(1970, 1, 1)).days + 0.5)
    assert half["b"].cross_date == day(0)


def test_strict_running_total(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0)])
    strict = [r.running for r in running_total(df, "slot", "x", ["k"], na_rm=False).orderBy("slot").collect()]
    assert strict == [1.0, None, None]


def test_peaks_need_rise_then_fall(spark):
    x = [1.0, 5.0, 2.0, 4.0, 4.0, 1.0, 9.0, 3.0, 3.5, 3.0]
    df = frame(spark, [("a", i, v) for i, v in enumerate(x)])
    out = [(r.t, r.height, r.peak_rank) for r in find_peaks(df, "slot", "x", ["k"], 3, 1.0).orderBy("peak_rank").collect()]
    assert out == [(6, 9.0, 1), (1, 5.0, 2)]
    all_of_them = find_peaks(df, "slot", "x", ["k"], 9).count()
    assert all_of_them == 3
