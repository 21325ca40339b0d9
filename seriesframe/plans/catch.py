"""Subsample expansion, effort, and abundance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.functions.lookups import (
    BAY_WIDTH,
    CURRENT_SCALE,
    DEFAULT_VOLUME,
    FISHED_VOLUME,
    GEAR_DEPTH,
    GEAR_RATIO,
    SURFACE_TO_DEPTH,
)
from seriesframe.functions.semantics import safe_divide
from seriesframe.functions.times import DAY_S
from seriesframe.operators.clean import lookup
from seriesframe.operators.relate import attach, join_full, join_keep_left
from seriesframe.operators.running import cumulative_share, zero_fill
from seriesframe.operators.summarise import share_small
from seriesframe.sources.files import settle
from seriesframe.sources.spines import day_spine, one_value


def category_counts(specimens: DataFrame, keys: list[str], ids: list[str], name: str = "n_cat") -> DataFrame:
    """Distinct specimens per key set. Spark first hashes on keys and ids together, so a hot
    key is deduplicated all over the cluster before its count is formed."""
    return specimens.groupBy(*keys).agg(F.countDistinct(*ids).alias(name))


def expand_run(
    events: DataFrame, specimens: DataFrame, event: str, category: str, ids: list[str], total: str, released: str
) -> DataFrame:
    """Spread each event's released fish over its categories.

    ``n_exp = n_cat + released * n_cat / (total - released)``; where that is missing (nothing
    sampled, or no category) the event total stands.
    """
    known = specimens.where(F.col(category).isNotNull())
    return expand_counts(events, category_counts(known, [event, category], ids), event, total, released)


def expand_counts(events: DataFrame, counts: DataFrame, event: str, total: str, released: str) -> DataFrame:
    """``expand_run`` for counts (``n_cat``) that exist already, one row per event and category."""
    out = join_keep_left(events, counts, [event])
    out = out.withColumn("propn_obs", safe_divide(F.col("n_cat"), F.col(total) - F.col(released)))
    expanded = F.col("n_cat") + F.col(released) * F.col("propn_obs")
    return out.withColumn("n_exp", F.coalesce(expanded, F.col(total).cast("double")))


def expand_season(
    events: DataFrame, specimens: DataFrame, event: str, category: str, ids: list[str], released: str,
    by: list[str] | None = None,
) -> DataFrame:
    """Category totals with the released fish spread by each event's sampled shares.

    ``by`` (such as a date column of ``events``) asks for totals per day instead of per season.
    """
    by = by or []
    per_event = category_counts(specimens, [event, category], ids, "_assigned")
    # One row per category is left of each event, so the window holds a handful of rows.
    per_event = share_small(per_event, "_assigned", [event], "_propn")
    sheet = events.select(event, *by, F.when(F.col(released) != 0, F.col(released)).alias("_released"))
    found = join_keep_left(per_event, sheet, [event], "inner")
    out = found.groupBy(*by, category).agg(
        F.sum("_assigned").alias("n_old"), F.sum(F.col("_released") * F.col("_propn")).alias("n_added")
    )
    out = out.withColumn("n_new", F.coalesce(F.col("n_old") + F.col("n_added"), F.col("n_old").cast("double")))
    out = share_small(out, "n_old", by, "old_share")
    return share_small(out, "n_new", by, "new_share")


def with_volume(df: DataFrame, gear: str, seconds: str, volumes=FISHED_VOLUME, default=DEFAULT_VOLUME,
                name: str = "fished_vol") -> DataFrame:
    """Water volume by gear and run length; other run lengths take their gear's default.

    A gear without a default has no volume then: another gear's volume says nothing about it.
    """
    table = {(g, s): v for g, runs in volumes.items() for s, v in runs.items()}
    found = lookup(df, table, [gear, seconds], name)
    for g, v in default.items():
        found = found.withColumn(name, F.coalesce(name, F.when(F.col(gear) == g, F.lit(float(v)))))
    return found


def scaled_by_depth(x: str | Column, depth: str, factors: dict[int, float]) -> Column:
    """Value times the factor of its depth; depths without a factor keep it."""
    value = F.col(x) if isinstance(x, str) else x
    out = value
    for d, f in factors.items():
        out = F.when(F.col(depth) == d, value * f).otherwise(out)
    return out


def gear_depth(gear: str, depths: dict[str, float] = GEAR_DEPTH, default: float = GEAR_DEPTH["RST"]) -> Column:
    c = F.lit(default)
    for g, d in depths.items():
        c = F.when(F.col(gear) == g, F.lit(d)).otherwise(c)
    return c


def swept_volume(velocity: str | Column, seconds: str, depth: Column | float, width: float = BAY_WIDTH) -> Column:
    """Water passing the bay during a run."""
    v = F.col(velocity) if isinstance(velocity, str) else velocity
    d = depth if isinstance(depth, Column) else F.lit(depth)
    return F.lit(width) * d * v * F.col(seconds)


def effort_metrics(df: DataFrame, catch: str, velocity: str, seconds: str) -> DataFrame:
    """Catch per volume, per velocity and per velocity-second; zero effort gives null."""
    per_v = safe_divide(catch, velocity)
    return df.withColumns(
        {
            "cpue": safe_divide(catch, "fished_vol"),
            "per_velocity": per_v,
            "per_velocity_s": safe_divide(per_v, seconds),
        }
    )


def abundance_m1(expanded: DataFrame, discharge: DataFrame, date: str, event: str) -> DataFrame:
    """Daily abundance = mean CPUE x mean discharge x seconds of a day.

    CPUE averages per event first and then per day: the mean of event means.
    """
    per_event = expanded.groupBy(date, event).agg(F.sum("n_exp").alias("_n"), F.avg("cpue").alias("_cpue"))
    daily = per_event.groupBy(date).agg(F.sum("_n").alias("total_n_exp"), F.avg("_cpue").alias("mean_cpue"))
    out = join_keep_left(daily, discharge, [date])
    return out.withColumn("daily_ia", F.col("mean_cpue") * F.col("mean_discharge") * F.lit(DAY_S))


def abundance_m2(
    expanded: DataFrame, date: str, event: str, velocity: str, seconds: str, by: list[str] | None = None,
    depth: float = GEAR_DEPTH["RST"], width: float = BAY_WIDTH,
) -> DataFrame:
    """Daily mean abundance = CPUE x water passing the bay, mean of event means."""
    by = by or []
    ia = expanded.withColumn("_ia", F.col("cpue") * swept_volume(velocity, seconds, depth, width))
    per_event = ia.groupBy(*by, date, event).agg(F.sum("n_exp").alias("_n"), F.avg("_ia").alias("_ia"))
    return per_event.groupBy(*by, date).agg(
        F.sum("_n").alias("total_n_exp"), F.avg("_ia").alias("mean_ia")
    )


def event_abundance(expanded: DataFrame, velocity: str | Column, seconds: str, gear: str,
                    depth: Column | None = None, name: str = "ia") -> DataFrame:
    """Abundance of each event row with the depth its gear fishes."""
    reach = depth if depth is not None else gear_depth(gear)
    return expanded.withColumn(name, F.col("cpue") * swept_volume(velocity, seconds, reach))


def abundance_by_depth(expanded: DataFrame, date: str, depth: str, velocity: str, seconds: str, gear: str) -> DataFrame:
    """Daily totals per depth and their share of the day."""
    ia = event_abundance(expanded, velocity, seconds, gear)
    daily = ia.groupBy(date, depth).agg(F.sum("ia").alias("ia_depth"))
    return share_small(daily, "ia_depth", [date], "share_of_day")


def abundance_m4(expanded: DataFrame, date: str, depth: str, velocity: str, seconds: str, gear: str,
                 factors: dict[int, float] = CURRENT_SCALE, by: list[str] | None = None) -> DataFrame:
    """Daily totals with the current scaled down by depth; ``by`` (such as the depth) parts them further."""
    current = scaled_by_depth(velocity, depth, factors)
    ia = event_abundance(expanded, current, seconds, gear)
    return ia.groupBy(date, *(by or [])).agg(F.sum("ia").alias("m4_total"))


def abundance_m5(events: DataFrame, date: str, depth: str, velocity: str, seconds: str,
                 ratio: float = GEAR_RATIO, factors: dict[int, float] = CURRENT_SCALE,
                 by: list[str] | None = None) -> DataFrame:
    """Daily totals with catches below the surface raised to the surface gear; ``by`` parts them further."""
    raised = F.when(F.col(depth) != 0, F.col("cpue") * ratio).otherwise(F.col("cpue"))
    ia = raised * swept_volume(scaled_by_depth(velocity, depth, factors), seconds, GEAR_DEPTH["RST"])
    return events.withColumn("_ia", ia).groupBy(date, *(by or [])).agg(F.sum("_ia").alias("m5_total"))


def season_curve(daily: DataFrame, date: str, value: str, by: list[str]) -> DataFrame:
    """Every day of the season for each group: empty days as 0, running sum, and its part of the group's total.

    ``daily`` has one row per group and date, so a group's window is bounded by the calendar.
    """
    daily = settle(daily.select(*by, date, value), "curve")
    ends = {"_lo": one_value(daily, F.min(date)), "_hi": one_value(daily, F.max(date))}
    spine = day_spine(daily.select(*by).distinct().withColumns(ends), "_lo", "_hi", date)
    return cumulative_share(zero_fill(daily, date, [value], spine, by), date, value, by)


def depth_totals(by_depth: DataFrame, depth: str, value: str) -> DataFrame:
    """Season total per depth and its part of the whole; depths are a handful."""
    return share_small(by_depth.groupBy(depth).agg(F.sum(value).alias("total")), "total", [])


def surface_to_depth(events: DataFrame, unit: list[str], depth: str, value: str,
                     factors: dict[int, float] = SURFACE_TO_DEPTH) -> DataFrame:
    """Surface total per unit, and what the factors make of it at each depth.

    Units fished only at depth appear with a surface total of 0.
    """
    at_surface = events.where(F.col(depth) == 0).groupBy(*unit).agg(F.sum(value).alias("surface"))
    below = events.where(F.col(depth) != 0).select(*unit).distinct()
    out = join_full(at_surface, below, unit)
    out = out.withColumn("surface", F.coalesce(F.col("surface"), F.lit(0.0)))
    return out.withColumns({f"depth_{d}": F.col("surface") * f for d, f in factors.items()})


def paired_ratio(df: DataFrame, unit: list[str], gear: str, a: str, b: str, value: str) -> DataFrame:
    """Mean and sd of the a/b ratio over units where both gears caught something."""
    per_gear = lambda g: F.sum(F.when(F.col(gear) == g, F.col(value)))
    units = df.groupBy(*unit).agg(per_gear(a).alias("_a"), per_gear(b).alias("_b"))
    both = units.where((F.col("_a") > 0) & (F.col("_b") > 0)).withColumn("_f", F.col("_a") / F.col("_b"))
    return both.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("_f").alias("mean_ratio"), F.stddev_samp("_f").alias("sd_ratio")
    )


def effort_summary(df: DataFrame, by: list[str], event: str, seconds: str, catch: str) -> DataFrame:
    """Volume, hours, events and catch per group; ``df`` has one row per event."""
    return df.groupBy(*by).agg(
        F.sum("fished_vol").alias("sum_vol"),
        (F.sum(seconds) / 3600).alias("hours"),
        F.countDistinct(event).alias("n_events"),
        F.sum(catch).alias("total_catch"),
    ).withColumn("vol_per_event", F.col("sum_vol") / F.col("n_events"))


def catch_per_run(events: DataFrame, date: str, event: str, catch: str, seconds: str, discharge: DataFrame) -> DataFrame:
    """Catch per ten runs, per discharge (x 1000) and per discharge-second (x 10^7) by day."""
    daily = events.groupBy(date).agg(
        F.sum(catch).alias("total"), F.countDistinct(event).alias("n_runs"), F.sum(seconds).alias("run_s")
    )
    out = join_keep_left(daily, discharge, [date])
    per_discharge = safe_divide("total", "mean_discharge")
    return out.withColumns(
        {
            "per_ten_runs": F.col("total") / F.col("n_runs") * 10,
            "per_discharge": per_discharge * 1000,
            "per_discharge_s": safe_divide(per_discharge, "run_s") * 1e7,
        }
    )


def every_other_day(date: str, start: Column, offset: int = 0) -> Column:
    """Every second day counted from ``start``; offsets 0 and 1 part the days between them."""
    return F.pmod(F.date_diff(F.col(date), start), F.lit(2)) == offset


def scheme_daily_share(daily: DataFrame, date: str, category: str, value: str, schemes: dict[str, Column]) -> DataFrame:
    """Each category's share of the day's total for the days of each scheme; other days are null.

    ``daily`` has one row per date and category, so the window of a day holds a handful of rows.
    """
    shared = share_small(daily, value, [date])
    return shared.select(date, category, *[F.when(p, F.col("share")).alias(f"share_{s}") for s, p in schemes.items()])


def compare_schemes(daily: DataFrame, date: str, category: str, value: str, schemes: dict[str, Column]) -> DataFrame:
    """Category totals and shares under several choices of sampling days, in one pass."""
    sums = daily.groupBy(category).agg(
        *[F.sum(F.when(p, F.col(value)).otherwise(0.0)).alias(f"sum_{s}") for s, p in schemes.items()]
    )
    out = sums
    totals = sums.agg(*[F.sum(f"sum_{s}").alias(f"_t_{s}") for s in schemes])
    out = attach(out, totals, [])
    return out.select(
        category,
        *[c for s in schemes for c in (F.col(f"sum_{s}"), safe_divide(f"sum_{s}", f"_t_{s}").alias(f"share_{s}"))],
    )
