"""Missing-value, text and time rules on tiny frames."""

import datetime as dt

from pyspark.sql import functions as F

from seriesframe.functions import semantics as sem, text, times


def one(df):
    return df.first()[0]


def test_strict_aggregates_propagate_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    out = df.groupBy("k").agg(
        sem.aggregate(F.sum, "x", na_rm=False).alias("strict"), sem.aggregate(F.sum, "x").alias("skip")
    )
    assert {r.k: (r.strict, r.skip) for r in out.collect()} == {"a": (None, 1.0), "b": (6.0, 6.0)}


def test_lenient_cast_and_sentinels(spark):
    df = spark.createDataFrame([("12",), ("NR",), ("",), (None,), ("#DIV/0!",)], "x string")
    assert [r[0] for r in df.select(sem.lenient_cast("x", "int")).collect()] == [12, None, None, None, None]
    kept = df.where(sem.reject("x", ["NR", "", "#DIV/0!"])).collect()
    assert [r.x for r in kept] == ["12"]


def test_keys_keep_missing_parts_visible(spark):
    df = spark.createDataFrame([("20170403", None), ("20170403", "1")], "d string, run string")
    key = text.make_key("d", F.concat(F.lit("R"), F.coalesce("run", F.lit("NA"))))
    assert [r[0] for r in df.select(key).collect()] == ["20170403-RNA", "20170403-R1"]
    assert [r[0] for r in df.select(text.make_key("d", "run")).collect()] == ["20170403-NA", "20170403-1"]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1, 0), (1, 2)], "a int, b int")
    assert [r[0] for r in df.select(sem.safe_divide("a", "b")).collect()] == [None, 0.5]


def test_distinct_count_with_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "k string, x int")
    out = df.groupBy("k").agg(sem.n_distinct("x", count_null=True).alias("n"))
    assert {r.k: r.n for r in out.collect()} == {"a": 2, "b": 1}


def test_order_puts_missing_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in df.orderBy(sem.nulls_last("x")).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(sem.nulls_last("x", True)).collect()] == [2, 1, None]


def test_rounding_ties_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(sem.round_even("x")).collect()] == [0.0, 2.0, 2.0]


def test_week_is_counted_from_new_year(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2017, 1, 8),), (dt.date(2017, 12, 31),)], "d date")
    assert [r[0] for r in df.select(times.week_of_year("d")).collect()] == [1, 2, 53]


def test_hhmm_without_leading_zero(spark):
    df = spark.createDataFrame([(dt.date(2017, 4, 3), v) for v in (607, 1225, 5, 2460, 1261)], "d date, t int")
    out = [r[0] for r in df.select(times.parse_hhmm("d", "t")).collect()]
    day = dt.datetime(2017, 4, 3)
    assert out == [day.replace(hour=6, minute=7), day.replace(hour=12, minute=25), day.replace(minute=5), None, None]


def test_runtime_counts_hours(spark):
    df = spark.createDataFrame([("0:15",), ("1:05",), ("NR",), (None,)], "t string")
    assert [r[0] for r in df.select(times.runtime_seconds("t")).collect()] == [900, 3900, None, None]


def test_epoch_round_trip_ignores_session_zone(spark):
    ts = dt.datetime(2017, 3, 12, 2, 30, 15, 250000)  # does not exist in some zones
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Vancouver")
    try:
        assert one(df.select(times.from_epoch_micros(times.epoch_micros("ts")))) == ts
        assert one(df.select(times.slot_start(times.slot_of("ts", 1800), 1800))) == ts.replace(second=0, microsecond=0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_round_to_half_hour_goes_up_at_the_half(spark):
    rows = [dt.datetime(2017, 4, 3, 9, 14, 59), dt.datetime(2017, 4, 3, 9, 15), dt.datetime(2017, 4, 3, 9, 45)]
    df = spark.createDataFrame([(t,) for t in rows], "ts timestamp_ntz")
    out = [r[0].strftime("%H:%M") for r in df.select(times.round_to("ts", 1800)).collect()]
    assert out == ["09:00", "09:30", "10:00"]


def test_two_digit_years_and_bad_dates(spark):
    df = spark.createDataFrame([("03-Apr-17",), ("n/a",)], "d string")
    assert [r[0] for r in df.select(times.parse_date("d", "dd-MMM-yy")).collect()] == [dt.date(2017, 4, 3), None]


def test_separate_splits_on_the_last_blank(spark):
    df = spark.createDataFrame([("2017 Apr 3 09:15",), ("none",)], "x string")
    out = df.select(*text.separate("x", " (?=[^ ]+$)", ["day", "clock"])).collect()
    assert [tuple(r) for r in out] == [("2017 Apr 3", "09:15"), ("none", None)]


def test_collapse_leaves_other_labels(spark):
    df = spark.createDataFrame([("a1",), ("a2",), ("b",), (None,)], "x string")
    out = [r[0] for r in df.select(sem.collapse("x", {"a": ["a1", "a2"]})).collect()]
    assert out == ["a", "a", "b", None]
