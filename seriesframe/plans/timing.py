"""Run timing: how categories and sites pass over the season."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesframe.operators.relate import join_keep_left
from seriesframe.operators.running import by_date, crossing, cumulative_share, find_peaks, zero_fill
from seriesframe.operators.summarise import argmax_rows
from seriesframe.sources.files import settle
from seriesframe.sources.spines import day_spine


def run_timing(df: DataFrame, date: str, category: str, value: str) -> DataFrame:
    """First, last and peak date and the 50 % date of each category.

    The earliest date stands for tied peaks.
    """
    daily = settle(by_date(df, date, value, [category], "n"), "daily")
    ends = daily.where(F.col("n") > 0).groupBy(category).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sum("n").alias("total")
    )
    peaks = argmax_rows(daily, [category], "n").groupBy(category).agg(
        F.min(date).alias("peak_date"), F.first("n").alias("peak_n")
    )
    half = crossing(cumulative_share(daily, date, "n", [category]), date, "cum_share", 0.5, [category])
    half = half.withColumnsRenamed({"cross_date": "half_date", "cross_day": "half_day"})
    return join_keep_left(join_keep_left(ends, peaks, [category]), half, [category])


def compare_sites(a: DataFrame, b: DataFrame, date: str, value: str, n_peaks: int = 3, threshold: float = 0.0) -> DataFrame:
    """Zero-filled daily series of two sites side by side, with running shares and peaks.

    The calendar spans both sites, so each has a value on every day.
    """
    daily_a, daily_b = [settle(by_date(s, date, value, [], "n"), "daily") for s in (a, b)]
    days = daily_a.unionByName(daily_b).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    spine = day_spine(days, "_lo", "_hi", date)

    def one(counts: DataFrame, tag: str) -> DataFrame:
        daily = zero_fill(counts, date, ["n"], spine, [])
        curve = cumulative_share(daily, date, "n", [], "run", "cum")
        peaks = find_peaks(daily, date, "n", [], n_peaks, threshold).select(F.col("t").alias(date), "peak_rank")
        out = join_keep_left(curve, peaks, [date])
        return out.withColumnsRenamed(
            {"n": f"{tag}_n", "run": f"{tag}_run", "cum": f"{tag}_cum", "peak_rank": f"{tag}_peak"}
        )

    return join_keep_left(one(daily_a, "a"), one(daily_b, "b"), [date])
