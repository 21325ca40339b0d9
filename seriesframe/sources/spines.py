"""Calendar and number spines.

A spine is produced in two explodes: first one row per block of slots, which is spread over
the cluster, then the slots of each block. No task builds a whole long range in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesframe.functions.times import slot_of, slot_start

BLOCK = 4096


def expand_slots(
    df: DataFrame, lo: str, hi: str, slot: str = "slot", block: int = BLOCK, spread: bool = True
) -> DataFrame:
    """One row per slot number ``lo..hi`` of each input row; ``lo`` and ``hi`` are dropped.

    ``spread`` sends the blocks of a long range to different tasks; inputs with many short
    ranges are spread already and skip that shuffle.
    """
    first, last = F.floor(F.col(lo) / block), F.floor(F.col(hi) / block)
    keep = [c for c in df.columns if c not in (lo, hi)]
    rows = df.where(F.col(lo) <= F.col(hi))
    if spread:
        # Blocks of blocks first, so the list of a very long range is no single array either.
        outer = F.sequence(F.floor(first / block), F.floor(last / block))
        rows = rows.select(*df.columns, F.explode(outer).alias("_outer")).repartition(*keep, "_outer")
        inner = F.sequence(F.greatest(first, F.col("_outer") * block), F.least(last, F.col("_outer") * block + (block - 1)))
        blocks = rows.select(*df.columns, F.explode(inner).alias("_block")).repartition(*keep, "_block")
    else:
        blocks = rows.select(*df.columns, F.explode(F.sequence(first, last)).alias("_block"))
    start = F.greatest(F.col(lo), F.col("_block") * block)
    stop = F.least(F.col(hi), F.col("_block") * block + (block - 1))
    return blocks.select(*keep, F.explode(F.sequence(start, stop)).alias(slot))


def time_spine(bounds: DataFrame, lo: str, hi: str, step_s: int, name: str = "t") -> DataFrame:
    """Timestamps from ``lo`` to ``hi`` in steps of ``step_s``, per row of ``bounds``.

    Both ends snap down to the step, as a season start and end do.
    """
    keep = [c for c in bounds.columns if c not in (lo, hi)]
    b = bounds.select(*keep, slot_of(lo, step_s).alias("_lo"), slot_of(hi, step_s).alias("_hi"))
    return expand_slots(b, "_lo", "_hi", "_slot").select(*keep, slot_start("_slot", step_s).alias(name))


def day_spine(bounds: DataFrame, lo: str, hi: str, name: str = "date") -> DataFrame:
    """Dates from ``lo`` to ``hi``, per row of ``bounds``."""
    keep = [c for c in bounds.columns if c not in (lo, hi)]
    b = bounds.select(
        *keep,
        F.unix_date(F.to_date(lo)).cast("long").alias("_lo"),
        F.unix_date(F.to_date(hi)).cast("long").alias("_hi"),
    )
    return expand_slots(b, "_lo", "_hi", "_slot").select(
        *keep, F.date_from_unix_date(F.col("_slot").cast("int")).alias(name)
    )


def id_range(spark: SparkSession, lo: int, hi: int, name: str = "id") -> DataFrame:
    """Integers ``lo..hi`` as a distributed range."""
    return spark.range(lo, hi + 1).withColumnRenamed("id", name)


def one_value(df: DataFrame, aggregate: Column) -> Column:
    """A single aggregate of ``df`` as a scalar subquery, to use as a column elsewhere."""
    return df.agg(aggregate).scalar()
