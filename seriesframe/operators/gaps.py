"""Statistics of missing stretches in gridded series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesframe.operators.relate import attach
from seriesframe.operators.scan import CHUNK, nearest_observed


def gap_runs(df: DataFrame, by: list[str], slot: str, value: str, size: int = CHUNK) -> DataFrame:
    """One row per run of nulls: ``gap_start``, ``gap_end`` (slots) and ``gap_size``.

    Every null of a run has the same last observation before it, so the run is a plain
    group: a gap of any length is counted with partial aggregates.
    """
    near = nearest_observed(df, by, slot, value, size).where(F.col(value).isNull())
    return (
        near.groupBy(*by, "prev_slot")
        .agg(F.min(slot).alias("gap_start"), F.max(slot).alias("gap_end"), F.count(F.lit(1)).alias("gap_size"))
        .drop("prev_slot")
    )


def gap_sizes(runs: DataFrame, by: list[str]) -> DataFrame:
    """How often each gap size occurs, and the nulls it accounts for."""
    return runs.groupBy(*by, "gap_size").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.sum("gap_size").alias("n_nulls")
    )


def gap_stats(df: DataFrame, by: list[str], slot: str, value: str, size: int = CHUNK) -> DataFrame:
    """Length, nulls, share of nulls, gaps, longest and commonest gap of each series.

    Commonest: the most frequent size, the smaller one on a tie. A series without nulls has 0
    gaps and null sizes.
    """
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_slots"),
        (F.count(F.lit(1)) - F.count(value)).alias("n_null"),
    )
    sizes = gap_sizes(gap_runs(df, by, slot, value, size), by)
    gaps = sizes.groupBy(*by).agg(
        F.sum("n_gaps").alias("n_gaps"),
        F.max("gap_size").alias("longest_gap"),
        F.min_by("gap_size", F.struct(-F.col("n_gaps"), F.col("gap_size"))).alias("commonest_gap"),
    )
    return attach(totals, gaps, by).withColumns(
        {
            "n_gaps": F.coalesce(F.col("n_gaps"), F.lit(0).cast("long")),
            "null_share": F.try_divide(F.col("n_null").cast("double"), F.col("n_slots").cast("double")),
        }
    )


def gap_bins(df: DataFrame, by: list[str], slot: str, value: str, bins: int = 20) -> DataFrame:
    """Share of nulls in ``bins`` stretches of (almost) equal length along each series.

    The first ``n mod bins`` stretches hold one slot more. The bin follows from the slot's
    position, so no series is sorted.
    """
    ends = df.groupBy(*by).agg(F.min(slot).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    at = attach(df, ends, by).withColumns(
        {"_i": F.col(slot) - F.col("_lo"), "_q": F.floor(F.col("_n") / bins), "_r": F.col("_n") % bins}
    )
    head = F.col("_r") * (F.col("_q") + 1)
    late = F.when(F.col("_q") > 0, F.col("_r") + F.floor((F.col("_i") - head) / F.greatest(F.col("_q"), F.lit(1))))
    b = F.when(F.col("_i") < head, F.floor(F.col("_i") / (F.col("_q") + 1))).otherwise(late) + 1
    return at.groupBy(*by, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_slots"),
        (F.count(F.lit(1)) - F.count(value)).alias("n_null"),
        F.avg(F.col(value).isNull().cast("int")).alias("null_share"),
    )
