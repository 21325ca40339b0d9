"""Exact grouped medians that need no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesframe.operators.scan import range_chunks, running_count


def grouped_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median of ``value`` per group; null values take no part.

    Equal values of a group are first counted, on the map side too. The counted values are cut by range
    partitioning on (group, value), so a group of any size spreads over the tasks, and running counts
    with one carried row per group and chunk tell which values hold the middle ranks. All groups
    take this way, whatever their size.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    seen = df.where(F.col(value).isNotNull()).select(key.alias("_g"), F.col(value).cast("double").alias("_x"))
    weights = seen.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_w"))
    cut = range_chunks(weights, ["_g", "_x"])
    ranked = running_count(cut, ["_g"], ["_x"], F.col("_w"), "_upto")
    sizes = cut.groupBy("_g").agg(F.sum("_w").alias("_n"))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    hit = lambda r: (F.col("_upto") - F.col("_w") < r) & (F.col("_upto") >= r)
    middle = ranked.join(sizes, "_g").where(hit(low) | hit(high))
    median = (F.max(F.when(hit(low), F.col("_x"))) + F.max(F.when(hit(high), F.col("_x")))) / 2
    return middle.groupBy("_g").agg(median.alias(name)).select(*[F.col("_g")[c].alias(c) for c in by], name)
