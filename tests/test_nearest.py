"""Nearest and tolerant joins against all pairs, with ranges far smaller than the keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesframe.operators import models, nearest, scan, summarise


def sides():
    """A hot key, ties, equal places on both sides, exact copies, missing keys and places."""
    rng = random.Random(12)
    a = [("hot", rng.randint(0, 400), rng.randint(0, 3)) for _ in range(300)] + [(k, rng.randint(0, 60), 1) for k in ("x", "y", None) for _ in range(20)]
    a += [("hot", 77, 1)] * 90 + [("alone", 5, 0), ("x", None, 0), (None, None, 0)]
    b = [("hot", rng.randint(0, 400), k) for k in range(120)] + [(k, rng.randint(0, 60), 200 + i) for k in ("x", "y", None) for i in range(6)]
    return a, b + [("other", 5, 900), ("x", None, 901)]


def brute(a, b, tolerance=None):
    out = []
    for key, at, v in a:
        near = [(abs(at - p), p, w) for k, p, w in b if at is not None and p is not None and k == key and (tolerance is None or abs(at - p) <= tolerance)]
        off, place, w = min(near) if near else (None, None, None)
        out.append((key, at, v, place, off, w))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 13])
@pytest.mark.parametrize("tolerance", [None, 2])
def test_nearest_number_equals_all_pairs(spark, parts, tolerance):
    a, b = sides()
    left = spark.createDataFrame(a, "k string, t long, v long").repartition(3)
    right = spark.createDataFrame(b, "k string, t long, w long").repartition(2)
    out = nearest.join_nearest(left, right, "t", ["k"], tolerance, parts=parts)
    assert out.columns == ["k", "t", "v", "t_matched", "distance", "w"]
    want = brute(a, b, tolerance)
    assert sorted(map(tuple, out.collect()), key=str) == want
    inner = nearest.join_nearest(left, right, "t", ["k"], tolerance, how="inner", parts=parts)
    assert sorted(map(tuple, inner.collect()), key=str) == [r for r in want if r[4] is not None]


def test_nearest_time_in_seconds(spark):
    t = lambda s: dt.datetime(2024, 3, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, t(10.5)), (2, t(100)), (3, t(1000))], "id long, ts timestamp_ntz")
    right = spark.createDataFrame([(t(10), "a"), (t(11), "b"), (t(160), "c")], "ts timestamp_ntz, name string")
    out = {r.id: (r["name"], r.distance, r.ts_matched) for r in nearest.join_nearest(left, right, "ts", [], 100).collect()}
    assert out == {1: ("a", 0.5, t(10)), 2: ("c", 60.0, t(160)), 3: (None, None, None)}
    days = [f.withColumn("ts", F.to_date("ts")) for f in (left, right)]
    assert {r.distance for r in nearest.join_nearest(*days, "ts", []).collect()} == {0.0}


def test_other_side_empty(spark):
    a, _ = sides()
    left = spark.createDataFrame(a, "k string, t long, v long")
    right = spark.createDataFrame([], "k string, t long, w long")
    out = nearest.join_nearest(left, right, "t", ["k"]).collect()
    assert len(out) == len(a) and all(r.distance is None and r.w is None for r in out)
    assert nearest.join_nearest(left.limit(0), right, "t", ["k"]).collect() == []


def test_within_a_tolerance_equals_all_pairs(spark):
    rng = random.Random(13)
    a = [(rng.choice("xy"), round(rng.uniform(-9, 9), 2)) for _ in range(150)] + [("x", None), (None, 1.0), ("x", 0.5)] * 2 + [("x", 1e300)]
    b = [(rng.choice("xy"), round(rng.uniform(-9, 9), 2), k) for k in range(150)] + [("x", 1.0, 900), ("x", float("nan"), 901)]
    left, right = spark.createDataFrame(a, "k string, u double"), spark.createDataFrame(b, "k string, v double, id long")
    out = nearest.join_within(left, right, ("u", "v"), 0.5, ["k"]).collect()
    want = [(k, u, v, i, u - v) for k, u in a for q, v, i in b if k == q and u is not None and v == v and abs(u - v) <= 0.5]
    assert sorted(map(tuple, out)) == sorted(want) and len(want) > 100
    with pytest.raises(ValueError):
        nearest.join_within(left, right, ("u", "v"), 0.0)


def test_copies_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(summarise, "COPIES", 7)
    rows = [("a", 1)] * 40 + [("a", 2)] * 3 + [("b", 1), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    out = summarise.duplicate_flags(df, ["k"], ["v"]).collect()
    assert sorted((str(r.k), str(r.v)) for r in out) == sorted((str(k), str(v)) for k, v in rows)
    assert sum(not r.dup_later for r in out) == 3 and {r.k for r in out if not r.dup_any} == {"b"}
    assert [r.v for r in out if r.k == "a" and not r.dup_later] == [1]
    counted = spark.createDataFrame([("x", 30), ("y", 1), ("z", 7)], "k string, n long")
    copies = summarise.repeat_rows(counted, "n").collect()
    assert sorted((r.k, r["copy"]) for r in copies) == sorted((k, c) for k, n in (("x", 30), ("y", 1), ("z", 7)) for c in range(1, n + 1))


def test_ranks_without_a_window_over_the_table(spark):
    values = [3.0, 1.0, 3.0, 2.0, 9.0, 9.0, 9.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = sorted((r.x is not None, r.x or 0, r["rank"]) for r in summarise.rank_rows(df, "x").collect())
    assert [g[2] for g in got] == [1, 2, 3, 4, 4, 6, 6, 6]


def test_pairs_in_blocks_of_levels(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(f"g{k % 11:02d}", rng.gauss(k % 11, 1)) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, y double")
    whole = sorted(map(tuple, models.pairwise_means(df, "y", "g").collect()))
    monkeypatch.setattr(models, "LEVELS", 3)
    small = sorted(map(tuple, models.pairwise_means(df, "y", "g").collect()))
    assert [r[:2] for r in small] == [r[:2] for r in whole] and len(small) == 55
    for x, y in zip(small, whole):
        assert x[2:] == pytest.approx(y[2:])


@pytest.mark.parametrize("size", [4, 4096])
def test_filling_down_from_the_seen_slots(spark, size):
    rng = random.Random(15)
    rows = [(k, s, rng.choice([None, s]), None if rng.random() < 0.5 else f"{k}{s}") for k in ("a", "b") for s in sorted(rng.sample(range(5, 90), 20))]
    seen = spark.createDataFrame(rows, "k string, slot long, u long, v string")
    ends = seen.groupBy("k").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = ends.select("k", F.explode(F.sequence("lo", "hi")).alias("slot")).join(seen, ["k", "slot"], "left")
    order = lambda df: sorted(map(tuple, df.select("k", "slot", "u", "v").collect()))
    assert order(scan.fill_down(grid, ["k"], "slot", ["u", "v"], size, seen)) == order(scan.fill_down(grid, ["k"], "slot", ["u", "v"], size))
