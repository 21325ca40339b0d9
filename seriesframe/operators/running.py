"""Cumulative curves over calendar tables.

The windows here run over tables that were aggregated to one row per group and date first, so
a group is never longer than the calendar. ``scan`` has the forms for long series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seriesframe.functions.times import epoch_micros
from seriesframe.operators.relate import join_keep_left


def by_date(df: DataFrame, date: str, value: str, by: list[str], name: str) -> DataFrame:
    """One total per group and date: the bounded input of the curves below."""
    return df.groupBy(*by, date).agg(F.sum(value).alias(name))


def running_total(daily: DataFrame, date: str, value: str, by: list[str], name: str = "running",
                  na_rm: bool = True) -> DataFrame:
    """Running sum by date; with ``na_rm=False`` everything after a missing value is missing."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(w)
    if not na_rm:
        total = F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), total)
    return daily.withColumn(name, total)


def cumulative_share(daily: DataFrame, date: str, value: str, by: list[str],
                     running: str = "running", name: str = "cum_share") -> DataFrame:
    """Running sum and its part of the group total; the curve ends at 1."""
    whole = Window.partitionBy(*by).orderBy(date).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    out = running_total(daily, date, value, by, running)
    return out.withColumn(name, F.try_divide(F.col(running), F.sum(value).over(whole)))


def crossing(curve: DataFrame, date: str, y: str, level: float, by: list[str]) -> DataFrame:
    """Where a rising curve first reaches ``level``: the date, and days since 1970 by a line.

    ``cross_day`` is the straight line between the last point below and the first at or above.
    """
    day = epoch_micros(F.col(date).cast("timestamp_ntz")) / F.lit(86400000000.0)
    pts = curve.select(*by, F.col(date).alias("cross_date"), F.col(y).alias("_y"), day.alias("_d"))
    w = Window.partitionBy(*by).orderBy("cross_date")
    pts = pts.withColumns({"_y0": F.lag("_y").over(w), "_d0": F.lag("_d").over(w)})
    hit = pts.where((F.col("_y") >= level) & (F.col("_y0").isNull() | (F.col("_y0") < level)))
    slope = (F.lit(level) - F.col("_y0")) / (F.col("_y") - F.col("_y0"))
    line = F.coalesce(F.col("_d0") + slope * (F.col("_d") - F.col("_d0")), F.col("_d"))
    first = hit.groupBy(*by).agg(
        F.min("cross_date").alias("cross_date"), F.min_by(line, "cross_date").alias("cross_day")
    )
    return first


def zero_fill(daily: DataFrame, date: str, values: list[str], spine: DataFrame, by: list[str]) -> DataFrame:
    """Every date of the spine, missing values as 0."""
    out = join_keep_left(spine, daily, [*by, date], "left", null_safe=True)
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0).cast(dict(daily.dtypes)[v])) for v in values})


def find_peaks(daily: DataFrame, t: str, x: str, by: list[str], n: int, threshold: float = 0.0) -> DataFrame:
    """The ``n`` highest peaks of each curve.

    A peak ends a stretch of rises and is followed at once by a stretch of falls. It counts
    when it stands at least ``threshold`` above the higher of the two troughs at the outer
    ends of these stretches. A flat step ends a stretch, so flat tops are no peaks.
    """
    w = Window.partitionBy(*by).orderBy("t")
    step = daily.select(*by, F.col(t).alias("t"), F.col(x).alias("x")).withColumn("_px", F.lag("x").over(w))
    signed = step.withColumn("_s", F.signum(F.col("x") - F.col("_px")).cast("int"))
    new_run = F.when(F.col("_s").eqNullSafe(F.lag("_s").over(w)), 0).otherwise(1)
    runs = signed.withColumn("_new", new_run).withColumn(
        "_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    stretch = runs.groupBy(*by, "_run", "_s").agg(
        F.min_by("_px", "t").alias("_from"), F.max_by("x", "t").alias("_to"), F.max("t").alias("t")
    )
    order = Window.partitionBy(*by).orderBy("_run")
    stretch = stretch.withColumns({"_next_s": F.lead("_s").over(order), "_next_to": F.lead("_to").over(order)})
    rise = F.col("_to") - F.greatest("_from", "_next_to")
    peaks = stretch.where((F.col("_s") == 1) & (F.col("_next_s") == -1)).withColumn("prominence", rise)
    best = Window.partitionBy(*by).orderBy(F.col("height").desc(), F.col("t"))
    return (
        peaks.where(F.col("prominence") >= threshold)
        .select(*by, "t", F.col("_to").alias("height"), "prominence")
        .withColumn("peak_rank", F.row_number().over(best))
        .where(F.col("peak_rank") <= n)
    )
