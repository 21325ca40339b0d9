"""Expansion, abundance and models on invented sheets."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesframe.functions.lookups import BAY_WIDTH, FISHED_VOLUME
from seriesframe.functions.semantics import safe_divide
from seriesframe.operators import models
from seriesframe.plans import catch
from seriesframe.plans.timing import compare_sites, run_timing

D1, D2 = dt.date(2017, 4, 3), dt.date(2017, 4, 4)


@pytest.fixture(scope="module")
def sheets(spark):
    events = spark.createDataFrame(
        [
            ("e1", D1, "RST", 0, 900, 0.5, 10, 6),  # four sampled, six let go
            ("e2", D1, "Vertical", 6, 600, 0.4, 3, 3),  # total = released: nothing to go by
            ("e3", D2, "RST", 0, 600, 0.0, 2, 0),
            ("e4", D2, "IPT", 12, 700, None, 0, 0),  # no specimens at all
        ],
        "event string, date date, gear string, depth_ft int, run_s int, velocity double, total long, released long",
    )
    fish = [("e1", "A", 1), ("e1", "A", 2), ("e1", "B", 3), ("e1", "B", 4), ("e1", "B", 4), ("e3", "A", 5), ("e3", None, 6)]
    specimens = spark.createDataFrame(fish, "event string, category string, id int")
    return events, specimens


def expand(sheets):
    return catch.expand_run(*sheets, "event", "category", ["id"], "total", "released")


def test_expansion_conserves_totals(sheets):
    out = expand(sheets).collect()
    per_event = {}
    for r in out:
        per_event[r.event] = per_event.get(r.event, 0) + r.n_exp
    assert per_event["e1"] == 10.0 and per_event["e2"] == 3.0 and per_event["e4"] == 0.0
    assert {r.category: r.n_exp for r in out if r.event == "e1"} == {"A": 5.0, "B": 5.0}


def test_season_expansion(sheets):
    out = {r.category: r for r in catch.expand_season(*sheets, "event", "category", ["id"], "released").collect()}
    assert out["A"].n_old == 3 and out["A"].n_new == 6.0
    assert out["B"].n_old == 2 and out["B"].n_new == 5.0
    daily = catch.expand_season(*sheets, "event", "category", ["id"], "released", by=["date"])
    assert {(r.date, r.category): r.n_new for r in daily.where("category = 'A'").collect()} == {(D1, "A"): 5.0, (D2, "A"): 1.0}


def test_volume_effort_and_abundance(sheets):
    ex = catch.with_volume(expand(sheets), "gear", "run_s").withColumn("cpue", safe_divide("n_exp", "fished_vol"))
    vol = {r.event: r.fished_vol for r in ex.collect()}
    assert vol["e3"] == FISHED_VOLUME["RST"][600] and vol["e1"] == 1865.71 and vol["e2"] == 545.95
    metrics = {(r.event, r.category): r for r in catch.effort_metrics(ex, "n_exp", "velocity", "run_s").collect()}
    assert metrics["e3", "A"].per_velocity is None and metrics["e1", "A"].per_velocity == 10.0
    m2 = {r.date: r.mean_ia for r in catch.abundance_m2(ex.where("gear = 'RST'"), "date", "event", "velocity", "run_s").collect()}
    assert m2[D1] == pytest.approx(5 / 1865.71 * BAY_WIDTH * 1.13 * 0.5 * 900)
    depth = catch.abundance_by_depth(ex.where("gear <> 'IPT'"), "date", "depth_ft", "velocity", "run_s", "gear")
    assert depth.where(F.col("date") == D1).agg(F.sum("share_of_day")).first()[0] == pytest.approx(1.0)
    m5 = catch.abundance_m5(ex.where("event = 'e2'"), "date", "depth_ft", "velocity", "run_s").first().m5_total
    assert m5 == pytest.approx(3 / 545.95 * 11.8 * BAY_WIDTH * 1.13 * 0.4 * 0.98 * 600)


def test_surface_scaling_keeps_units_fished_only_below(spark):
    df = spark.createDataFrame([("d", "b2", 0, 2.0), ("d", "b2", 6, 9.0), ("d", "b6", 12, 1.0)], "date string, bay string, depth int, n double")
    out = {r.bay: (r.surface, r.depth_6, r.depth_12) for r in catch.surface_to_depth(df, ["date", "bay"], "depth", "n").collect()}
    assert out["b2"] == (2.0, pytest.approx(13.6), 14.0) and out["b6"] == (0.0, 0.0, 0.0)


def test_paired_ratio_uses_units_with_both(spark):
    df = spark.createDataFrame([("u1", "RST", 8.0), ("u1", "Vertical", 2.0), ("u2", "RST", 6.0), ("u2", "Vertical", 3.0), ("u3", "RST", 1.0), ("u4", "RST", 1.0), ("u4", "Vertical", 0.0)], "u string, g string, v double")
    out = catch.paired_ratio(df, ["u"], "g", "RST", "Vertical", "v").first()
    assert (out.n_pairs, out.mean_ratio) == (2, 3.0) and out.sd_ratio == pytest.approx(np.sqrt(2))


def test_schemes_share_one_pass(spark):
    df = spark.createDataFrame([(D1, "A", 1.0), (D2, "A", 3.0), (D2, "B", 4.0)], "date date, c string, n double")
    out = catch.compare_schemes(df, "date", "c", "n", {"all": F.lit(True), "odd": F.dayofmonth("date") % 2 == 1})
    got = {r.c: (r.sum_all, r.share_all, r.sum_odd, r.share_odd) for r in out.collect()}
    assert got == {"A": (4.0, 0.5, 1.0, 1.0), "B": (4.0, 0.5, 0.0, 0.0)}


def test_run_timing_and_sites(spark):
    day = lambda i: D1 + dt.timedelta(days=i)
    rows = [("A", day(i), v) for i, v in enumerate([0.0, 2.0, 2.0, 0.0, 0.0])] + [("B", day(0), 1.0), ("B", day(6), 5.0)]
    df = spark.createDataFrame(rows, "c string, date date, n double")
    out = {r.c: r for r in run_timing(df, "date", "c", "n").collect()}
    assert (out["A"].first_date, out["A"].last_date, out["A"].peak_date, out["A"].half_date) == (day(1), day(2), day(1), day(1))
    assert out["B"].peak_date == day(6)
    sites = compare_sites(df.where("c = 'A'"), df.where("c = 'B'"), "date", "n").orderBy("date").collect()
    assert [r.a_n for r in sites] == [0.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0] and sites[-1].b_cum == 1.0


def test_regressions(spark):
    x = np.arange(20.0)
    y = 2 + 3 * x + np.sin(x)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    fit = models.ols(df, ["k"], "y", "x").first()
    slope, icept = np.polyfit(x, y, 1)
    rss = float(((y - icept - slope * x) ** 2).sum())
    assert (fit.slope, fit.intercept, fit.rss) == (pytest.approx(slope), pytest.approx(icept), pytest.approx(rss))
    ranked = {r.model: r for r in models.rank_models(df, "y", {"x": F.col("x"), "noise": F.sin("x")}).collect()}
    assert ranked["x"].model_rank == 1
    assert ranked["x"].aic == pytest.approx(20 * (np.log(2 * np.pi) + np.log(rss / 20) + 1) + 6)
    res = models.residuals(df, models.ols(df, ["k"], "y", "x"), ["k"], "y", "x")
    assert res.agg(F.sum("resid")).first()[0] == pytest.approx(0, abs=1e-9)


def test_anova_and_pairs(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0], "c": [9.0, 9.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, y double")
    table = models.anova(df, "y", "g").first()
    allv = np.concatenate([np.array(v) for v in groups.values()])
    ssb = sum(len(v) * (np.mean(v) - allv.mean()) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    assert (table.ss_between, table.ss_within) == (pytest.approx(ssb), pytest.approx(ssw))
    assert table.f_value == pytest.approx((ssb / 2) / (ssw / 5))
    pairs = {(r.group_a, r.group_b): r for r in models.pairwise_means(df, "y", "g").collect()}
    assert len(pairs) == 3 and pairs["a", "c"]["diff"] == 7.0
    assert pairs["a", "c"].std_error == pytest.approx(np.sqrt(ssw / 5 / 2 * (1 / 3 + 1 / 2)))


def test_generalised_models(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(1, 3, 400)
    mu = 1 / (0.2 + 0.3 * x)
    df = spark.createDataFrame([(float(a), float(rng.gamma(4, m / 4)), "ab"[i % 2]) for i, (a, m) in enumerate(zip(x, mu))], "x double, y double, f string")
    fit = models.glm(df, "y", ["x"], [], "gamma", "inverse")
    eta = fit.stages[-1].intercept + fit.stages[-1].coefficients[0] * x
    y = np.array([r.y for r in df.select("y").collect()])
    # score equations of the canonical link
    assert abs((y - 1 / eta).sum()) < 1e-5 and abs(((y - 1 / eta) * x).sum()) < 1e-5
    coef = models.glm_coefficients(models.glm(df, "y", ["x"], ["f"], "gaussian", "identity"), ["x"], ["f"], spark)
    assert sorted(r.term for r in coef.collect()) == ["(intercept)", "f=b", "x"]
    holes = df.withColumn("y", F.when(F.col("x") > 1.5, F.col("y")))
    for family, link in (("gaussian", "identity"), ("gamma", "inverse")):
        filled = models.glm_fill(holes, models.glm(holes, "y", ["x"], ["f"], family, link), "y", ["x"], ["f"])
        assert filled.where("filled is null or (y is not null and y <> filled)").count() == 0
    strange = spark.createDataFrame([(2.0, None, "new"), (None, 4.0, "a"), (None, None, None)], "x double, y double, f string")
    kept = models.glm_fill(strange, models.glm(df, "y", ["x"], ["f"], "gaussian", "identity"), "y", ["x"], ["f"])
    assert sorted(str(r.filled) for r in kept.collect()) == ["4.0", "None", "None"]


def test_zero_test(spark):
    n = [0] * 70 + [1, 2, 3] * 10
    out = models.zero_test(spark.createDataFrame([("a", v) for v in n], "k string, n int"), ["k"], "n").first()
    mean, rows = np.mean(n), len(n)
    p0 = np.exp(-mean)
    assert (out.n_zero, out.n_positive) == (70, 30)
    assert out.score == pytest.approx((70 - rows * p0) ** 2 / (rows * p0 * (1 - p0) - rows * mean * p0 * p0))
