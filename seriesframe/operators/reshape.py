"""Wide and long forms, padding inside groups, interval grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.functions.times import slot_of, slot_start
from seriesframe.operators.relate import not_in
from seriesframe.sources.files import settle
from seriesframe.sources.spines import expand_slots


#: Columns a wide table may get; more labels than this call for the long form.
MOST_LABELS = 2_000


def to_long(df: DataFrame, ids: list[str], key: str, value: str) -> DataFrame:
    """One row per row and column that is no id."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], key, value)


def labels_of(df: DataFrame, key: str, most: int = MOST_LABELS) -> list:
    """The distinct labels of a column in order; an error if there are more than ``most`` or some are missing."""
    found = [r[0] for r in df.select(key).distinct().orderBy(F.asc_nulls_first(key)).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} labels in {key}: keep the long form")
    if found and found[0] is None:
        raise ValueError(f"rows without a label in {key} would have no column: name or drop them first")
    return found


def to_wide(df: DataFrame, ids: list[str], key: str, agg: Column) -> DataFrame:
    """One column per label found in ``key``, so no row is left out."""
    return df.groupBy(*ids).pivot(key, labels_of(df, key)).agg(agg)


def pad(df: DataFrame, ts: str, step_s: int, by: list[str], t: str = "t") -> DataFrame:
    """One row per step between each group's first and last slot, plus the group's rows.

    Rows that start inside a slot are joined to it; empty slots carry nulls.
    """
    keyed = df.withColumn("_slot", slot_of(ts, step_s))
    used = settle(keyed.select(*by, "_slot").distinct(), "slots")
    ends = used.groupBy(*by).agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi"))
    gaps = not_in(expand_slots(ends, "_lo", "_hi", "_slot"), used, [*by, "_slot"], null_safe=True)
    # The rows themselves are not joined: only empty slots are added below them.
    rows = keyed.drop(ts) if t == ts else keyed
    out = rows.unionByName(gaps, allowMissingColumns=True)
    return out.withColumn(t, slot_start("_slot", step_s)).drop("_slot")


def interval_grid(df: DataFrame, start: str, end: str, step_s: int, keep: list[str], slot: str = "slot") -> DataFrame:
    """One row per step an interval covers, first and last step included.

    Steps come as slot numbers, ready to be aggregated and joined to a spine.
    """
    spans = df.select(*keep, slot_of(start, step_s).alias("_lo"), slot_of(end, step_s).alias("_hi"))
    return expand_slots(spans, "_lo", "_hi", slot, spread=False)
