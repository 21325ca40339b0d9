"""Joins, corrections, reshaping, files and summaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesframe.functions.times import trunc_to
from seriesframe.operators import clean, relate, reshape, summarise
from seriesframe.operators.grid import densify
from seriesframe.session import new_stage_path
from seriesframe.sources import files, spines


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_fan_out_join_equals_left_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (3, 30), (None, 5)], "k int, w int")
    assert rows(relate.join_fan_out(a, b, ["k"])) == rows(a.join(b, "k", "left"))
    safe = rows(relate.join_fan_out(a, b, ["k"], null_safe=True))
    assert (None, "z", 5) in safe and (2, "y", None) in safe and len(safe) == 5


def test_full_join_matches_missing_keys(spark):
    a = spark.createDataFrame([("d1", None, 1), ("d1", 6, 2)], "d string, depth int, n int")
    b = spark.createDataFrame([("d1", None, 7), ("d2", 6, 8)], "d string, depth int, m int")
    assert rows(relate.join_full(a, b, ["d", "depth"])) == [
        ("d1", 6, 2, None), ("d1", None, 1, 7), ("d2", 6, None, 8)
    ]


def test_keep_left_copy_of_shared_columns(spark):
    a = spark.createDataFrame([(1, "left")], "k int, note string")
    b = spark.createDataFrame([(1, "right", 5)], "k int, note string, x int")
    out = relate.join_keep_left(a, b, ["k"])
    assert out.columns == ["k", "note", "x"] and rows(out) == [(1, "left", 5)]


def test_fold_of_full_joins(spark):
    t = [spark.createDataFrame([(term, v)], f"term string, e{i} int") for i, (term, v) in enumerate([("a", 1), ("b", 2), ("a", 3)])]
    assert rows(relate.join_full_many(t, ["term"])) == [("a", 1, None, 3), ("b", None, 2, None)]


def test_fan_out_does_not_double_count(spark):
    fanned = spark.createDataFrame(
        [("d", "e1", 5), ("d", "e1", 5), ("d", "e2", 5), ("d2", "e3", None)], "date string, event string, total int"
    )
    out = summarise.event_sum(fanned, "event", "total", ["date"], "n")
    assert rows(out) == [("d", 10), ("d2", None)]


def test_corrections_and_deletes_are_keyed(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 3, 4), (3, 5, 6)], "id int, a int, b int")
    fixes = spark.createDataFrame([(1, 9, None)], "id int, a int, b int")
    gone = spark.createDataFrame([(3,)], "id int")
    assert rows(clean.apply_corrections(df, fixes, ["id"], gone)) == [(1, 9, 1), (2, 3, 4)]


def test_lookup_default_for_unknown_keys(spark):
    df = spark.createDataFrame([("RST", 600), ("Vertical", 900), ("RST", 900), (None, 600)], "gear string, s int")
    out = clean.lookup(df, {("RST", 600): 1243.836, ("Vertical", 900): 818.92}, ["gear", "s"], "v", 1865.71)
    assert rows(out) == [("RST", 600, 1243.836), ("RST", 900, 1865.71), ("Vertical", 900, 818.92), (None, 600, 1865.71)]


def test_pick_by_position(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert clean.pick(df, [3, 1]).columns == ["c", "a"]
    assert clean.pick(df, [-2]).columns == ["a", "c"]


def test_open_and_closed_time_range(spark):
    t = [dt.datetime(2017, 4, 3, h) for h in (1, 2, 3)]
    df = spark.createDataFrame([(x,) for x in t], "ts timestamp_ntz")
    ends = ("2017-04-03 01:00:00", "2017-04-03 03:00:00")
    assert clean.time_range(df, "ts", *ends).count() == 3
    assert clean.time_range(df, "ts", *ends, closed=False).count() == 1


def test_duplicate_flags(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, id int")
    assert rows(summarise.duplicate_flags(df, ["k"], ["id"])) == [
        ("a", 1, False, True), ("a", 2, True, True), ("b", 3, False, False)
    ]


def test_duplicate_flags_of_copies_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", None), ("b", 2), (None, 5), (None, 5), ("c", None)], "k string, id int")
    assert rows(summarise.duplicate_flags(df, ["k"], ["id"])) == sorted([
        ("a", 1, False, True), ("a", 1, True, True), ("a", 1, True, True), ("b", None, False, True), ("b", 2, True, True),
        (None, 5, False, True), (None, 5, True, True), ("c", None, False, False),
    ], key=str)


def flagged(rows_, key, order):
    """Brute force: each row in order within its key, missing values first, with both flags."""
    place = lambda r: tuple((r[i] is not None, r[i] if r[i] is not None else 0) for i in order)
    groups = {}
    for r in rows_:
        groups.setdefault(tuple(r[i] for i in key), []).append(r)
    return sorted([(*r, n > 0, len(g) > 1) for g in groups.values() for n, r in enumerate(sorted(g, key=place))], key=str)


def odd_rows():
    """A hot key, many exact copies, missing keys and values, single rows."""
    rows_ = [("hot", 1, i % 97, i) for i in range(300)] + [("copy", 2, 5, 5)] * 200 + [("copy", 2, None, 9)] * 3
    rows_ += [(None, k % 3 or None, k % 7 or None, k % 5) for k in range(60)]
    return rows_ + [(f"k{k % 40}", k % 5, k % 3 or None, k % 2) for k in range(120)]


def test_duplicate_flags_of_common_keys_take_one_shuffle(spark):
    df = spark.createDataFrame(odd_rows(), "k string, s int, v int, w int").repartition(5)
    out = summarise.duplicate_flags(df, ["k", "s"], ["v", "w"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Union" not in plan
    assert rows(out) == flagged(odd_rows(), (0, 1), (2, 3))


@pytest.mark.parametrize("buckets, large", [(16_384, 50), (3, 10), (1, 1)])
def test_duplicate_flags_of_large_buckets(spark, monkeypatch, buckets, large):
    monkeypatch.setattr(summarise, "BUCKETS", buckets)
    monkeypatch.setattr(summarise, "LARGE", large)
    df = spark.createDataFrame(odd_rows(), "k string, s int, v int, w int").repartition(5)
    out = summarise.duplicate_flags(df, ["k", "s"], ["v", "w"])
    assert rows(out) == flagged(odd_rows(), (0, 1), (2, 3))
    assert "hot" in {r.k for r in out.collect()} and "Join" in out._jdf.queryExecution().sparkPlan().toString()
    whole = summarise.duplicate_flags(df, [], ["v", "w", "k", "s"]).collect()
    assert [r[:4] for r in whole if not r.dup_later] == [(None, None, None, 0)] and all(r.dup_any for r in whole)


def test_duplicate_flags_of_keys_that_a_collation_holds_equal(spark, monkeypatch):
    monkeypatch.setattr(summarise, "LARGE", 1)
    df = spark.createDataFrame([("a", 2), ("A", 1), ("a", 3), ("b", 5)], "k string, v int")
    out = summarise.duplicate_flags(df.withColumn("k", F.collate("k", "UTF8_LCASE")), ["k"], ["v"])
    assert sorted((r.v, r.dup_later, r.dup_any) for r in out.collect()) == [
        (1, False, True), (2, True, True), (3, True, True), (5, False, False)
    ]


def test_missing_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "id long")
    assert rows(relate.missing_ids(df, "id")) == [(3,), (4,)]
    assert rows(relate.missing_ids(df, "id", (0, 6))) == [(0,), (3,), (4,), (6,)]


def test_best_row_and_ties(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 3, "w"), ("a", None, "y"), ("b", None, "z")], "k string, v int, t string")
    assert rows(summarise.keep_best(df, ["k"], [("v", True), ("t", False)])) == [("a", 3, "w"), ("b", None, "z")]
    assert rows(summarise.argmax_rows(df, ["k"], "v")) == [("a", 3, "w"), ("a", 3, "x")]


def test_wide_long_round_trip(spark):
    df = spark.createDataFrame([(1, "b2", 0.5), (1, "b6", 1.5), (2, "b2", 2.5)], "t int, bay string, v double")
    wide = reshape.to_wide(df, ["t"], "bay", F.first("v"))
    long = reshape.to_long(wide, ["t"], "bay", "v")
    assert rows(long.dropna()) == rows(df) and long.count() == 4


def test_wide_form_takes_every_label_or_fails(spark):
    df = spark.createDataFrame([(1, c, 1.0) for c in "abcdef"], "t int, bay string, v double")
    assert reshape.to_wide(df, ["t"], "bay", F.first("v")).columns == ["t", *"abcdef"]
    with pytest.raises(ValueError):
        reshape.labels_of(df, "bay", most=5)
    with pytest.raises(ValueError):
        reshape.to_wide(df.unionByName(spark.createDataFrame([(2, None, 1.0)], df.schema)), ["t"], "bay", F.first("v"))


def test_truncation_knows_no_daylight_saving(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Vancouver")
    try:
        df = spark.createDataFrame([(dt.datetime(2017, 3, 12, 2, 30, 40),)], "ts timestamp_ntz")
        got = df.select(trunc_to("ts", 60), trunc_to("ts", 3600)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (dt.datetime(2017, 3, 12, 2, 30), dt.datetime(2017, 3, 12, 2))


def test_densify_then_drop_gives_the_input(spark):
    t0 = dt.datetime(2017, 4, 3, 6)
    data = [("b2", t0, 1.0), ("b2", t0 + dt.timedelta(minutes=7), 2.0), ("b6", t0 + dt.timedelta(minutes=3), 3.0)]
    df = spark.createDataFrame(data, "bay string, ts timestamp_ntz, v double")
    grid = densify(df, "ts", 60, ["bay"], [F.avg("v").alias("v")])
    assert grid.count() == 16
    assert rows(grid.dropna(subset=["v"]).select("bay", "t", "v")) == rows(df)
    own = densify(df, "ts", 60, ["bay"], [F.avg("v").alias("v")], common=False)
    assert rows(own.groupBy("bay").count()) == [("b2", 8), ("b6", 1)]


def test_pad_adds_only_empty_slots(spark):
    t0 = dt.datetime(2017, 4, 3, 6)
    df = spark.createDataFrame([("u", t0, 1), ("u", t0, 2), ("u", t0 + dt.timedelta(minutes=2), 3), (None, t0, 4)],
                               "g string, ts timestamp_ntz, x int")
    out = rows(reshape.pad(df, "ts", 60, ["g"]).select("g", "t", "x"))
    assert len(out) == 5 and ("u", t0 + dt.timedelta(minutes=1), None) in out


def test_long_range_is_cut_into_blocks(spark):
    df = spark.createDataFrame([("a", -5, 20)], "k string, lo long, hi long")
    out = [r.slot for r in spines.expand_slots(df, "lo", "hi", block=7).orderBy("slot").collect()]
    assert out == list(range(-5, 21))


def test_csv_round_trip_keeps_blank_and_missing_apart(spark):
    df = spark.createDataFrame([(1, "", None), (2, 'say "a, b"', 2.5)], "id int, txt string, x double")
    path = new_stage_path(spark, "csv")
    files.write_survey_csv(df, path)
    assert rows(files.read_survey_csv(spark, path, df.schema)) == rows(df)


def test_tee_returns_the_written_rows(spark):
    df = spark.range(5).withColumn("u", F.rand(3))
    path = new_stage_path(spark, "tee")
    copy = files.tee(df, path)
    assert copy.count() == 5 and files.read_survey_csv(spark, path, df.schema).count() == 5


def test_cluster_needs_a_shared_folder():
    from seriesframe import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Fake())
