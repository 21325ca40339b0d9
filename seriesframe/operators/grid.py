"""Regular grids: one row per series and slot, empty slots as nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.functions.times import slot_of, slot_start
from seriesframe.operators.relate import attach, join_keep_left
from seriesframe.operators.scan import CHUNK, fill_down
from seriesframe.sources.files import settle
from seriesframe.sources.spines import expand_slots, one_value


def to_slots(df: DataFrame, ts: str, step_s: int, by: list[str], aggs: list[Column]) -> DataFrame:
    """One row per series and slot that has data."""
    return df.withColumn("slot", slot_of(ts, step_s)).groupBy(*by, "slot").agg(*aggs)


def grid_spine(slotted: DataFrame, by: list[str], common: bool = True) -> DataFrame:
    """All slots of each series, from its own ends or from the ends of the whole table."""
    ends = slotted.groupBy(*by).agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
    if common and by:
        ends = ends.withColumns(
            {"_lo": one_value(slotted, F.min("slot")), "_hi": one_value(slotted, F.max("slot"))}
        )
    return expand_slots(ends, "_lo", "_hi", "slot")


def densify(
    df: DataFrame,
    ts: str,
    step_s: int,
    by: list[str],
    aggs: list[Column],
    fill: dict[str, object] | None = None,
    common: bool = True,
    t: str = "t",
    reuse: bool = True,
) -> DataFrame:
    """Aggregate to slots and keep every slot of the season.

    Data and spine meet on (series, slot), so one long series spreads over all tasks. The slot
    table is written once, because its ends, its spine and the join read it: the source is
    scanned a single time. With ``reuse`` the grid is written too; imputation and gap
    statistics read it in several branches, which would otherwise join it anew each.
    """
    slotted = settle(to_slots(df, ts, step_s, by, aggs), "slots")
    spine = grid_spine(slotted, by, common)
    out = join_keep_left(spine, slotted, [*by, "slot"], "left", null_safe=True)
    if fill:
        types = dict(out.dtypes)
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in fill.items()})
    out = out.withColumn(t, slot_start("slot", step_s))
    return settle(out, "grid") if reuse else out


def densify_filled(
    df: DataFrame, ts: str, step_s: int, by: list[str], aggs: list[Column], cols: list[str], t: str = "t", size: int = CHUNK
) -> DataFrame:
    """``densify`` from each group's own first to its last slot, with the last values carried into empty slots.

    What a chunk hands on is known from the slots that have data, so the dense grid is neither written nor read twice.
    """
    slotted = settle(to_slots(df, ts, step_s, by, aggs), "slots")
    grid = join_keep_left(grid_spine(slotted, by, False), slotted, [*by, "slot"], "left", null_safe=True)
    return fill_down(grid, by, "slot", cols, size, slotted).withColumn(t, slot_start("slot", step_s))


def with_index(df: DataFrame, by: list[str], slot: str = "slot", name: str = "idx") -> DataFrame:
    """Row number of a dense series from its slot: no sort and no window."""
    first = df.groupBy(*by).agg(F.min(slot).alias("_lo"))
    return attach(df, first, by).withColumn(name, F.col(slot) - F.col("_lo") + 1).drop("_lo")
