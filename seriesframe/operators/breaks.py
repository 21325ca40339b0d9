"""Level shifts in the mean of a series, and rows assigned to the segments between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pyspark.sql.types import DoubleType

from seriesframe.functions.breakdist import reach
from seriesframe.operators.relate import attach, join_keep_left
from seriesframe.operators.scan import range_chunks, running_count, running_sums
from seriesframe.sources.files import settle

#: Positions of a block, whose ends meet their candidates in one matrix, and blocks of a stretch, which share a list of candidates.
BLOCK, SPAN = 1_000, 32


def _prefix_sums(points: DataFrame) -> DataFrame:
    """Per series (``_g``): position ``i`` from 1, and sums of the deviations from the mean and of their squares up to it."""
    means = points.groupBy("_g").agg(F.avg("_v").alias("_mu"), F.count(F.lit(1)).alias("_n"))
    x = F.col("_v") - F.col("_mu")
    cut = range_chunks(points.join(means, "_g").withColumn("_x", x), ["_g", "_t"])
    sums = {"i": F.lit(1.0), "s1": F.col("_x"), "s2": F.col("_x") * F.col("_x")}
    return running_sums(cut, ["_g"], ["_t"], sums).withColumn("i", F.round("i").cast("long")).drop("_x", "_chunk")


def contenders(i: np.ndarray, s1: np.ndarray, s2: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which places of an ascending list can be the last break for any end behind all of them.

    With the last break at j, the cost up to an end is g_j(m) plus what depends on the end and the last segment's level m
    alone. So a place counts only if its g is least for some level. An earlier place p is at least as good as a later one j
    between two levels around the mean of what lies between them, if at all; p goes when these intervals of all later places
    have no level in common, or when earlier places are as good on all of what they have.
    """
    # Rounding must not drop a place: intervals are taken a little wider, and narrower where they speak against a place.
    loose = 1e-9 * (np.abs(best).max(initial=0.0) + np.abs(s2).max(initial=0.0))

    def as_good(p: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Middle, slack and length of the intervals of earlier places p against later ones j."""
        d = np.maximum(i[j] - i[p], 1).astype(np.float64)
        middle = (s1[j] - s1[p]) / d
        return middle, best[j] - best[p] - (s2[j] - s2[p]) + middle * middle * d, d

    low, high, places = np.full(len(i), -np.inf), np.full(len(i), np.inf), np.arange(len(i))
    for at in range(0, len(i), 256):  # a bounded part of the pairs at a time
        p, j = places[at : at + 256, None], places[None, at:]
        middle, slack, d = as_good(p, j)
        half = np.sqrt(np.maximum(slack + loose, 0) / d)
        later, some = j > p, slack + loose >= 0
        low[at : at + 256] = np.where(later, np.where(some, middle - half, np.inf), -np.inf).max(axis=1)
        high[at : at + 256] = np.where(later, np.where(some, middle + half, -np.inf), np.inf).min(axis=1)
    kept: list[int] = []
    for p in np.flatnonzero(low <= high).tolist():
        middle, slack, d = as_good(np.array(kept, np.int64), np.full(len(kept), p))
        half = np.sqrt(np.maximum(slack - loose, 0) / d)
        speak = slack >= loose
        start, stop = (middle - half)[speak], (middle + half)[speak]
        reach, met = low[p], False
        for k in np.argsort(start):
            if start[k] > reach or reach > high[p]:
                break
            if stop[k] >= reach:
                reach, met = stop[k], True
        if not (met and reach >= high[p]):
            kept.append(p)
    out = np.zeros(len(i), bool)
    out[kept] = True
    return out


def _pruned(places: DataFrame, group: str) -> DataFrame:
    """The contenders of each group of places."""

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return rows[contenders(*(rows[c].to_numpy() for c in ("i", "s1", "s2", "best")))]

    return places.groupBy("_k", group).applyInPandas(prune, places.schema)


def _one_more_break(rows: DataFrame, before: DataFrame, breaks: int, most: int) -> DataFrame:
    """Least cost of the first ``i`` points in ``breaks`` + 1 segments, and where the last but one ends.

    Positions are cut into blocks. A block of ends meets all places of the one or two blocks that a shortest segment separates from
    it, and of the blocks before those only the contenders: each block's, and beyond the own stretch of SPAN blocks each
    stretch's. The lists are short, so the work grows little faster than a series' length; pairs of positions are never rows.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    # Blocks up to b - far - 1 are wholly a shortest segment away from block b, those after b - near not at all.
    far, near = F.ceil(F.col("shortest") / BLOCK), F.floor(F.col("shortest") / BLOCK)
    last = F.floor(F.col("_n") / BLOCK)
    kept = ["_k", "i", "s1", "s2", "best"]

    def sent(places: DataFrame, first: Column, end: Column) -> DataFrame:
        """Places for each block of ends from ``first`` to ``end``."""
        spans = places.withColumns({"_from": first, "_to": F.least(end, last)}).where("_from <= _to")
        return spans.select(*kept, F.explode(F.sequence("_from", "_to")).alias("_b"))

    places = before.where(F.col("i") >= F.col("shortest") * breaks).select(*kept, "shortest", "_n", block("i").alias("_a"))
    a = F.col("_a")
    earlier = sent(places, a + near, a + far)
    if most >= BLOCK:
        # Only blocks behind which another block can end are pruned.
        of_block = settle(_pruned(places.where(a + far < last), "_a"), "contenders")
        stretch = F.floor(a / SPAN)
        earlier = earlier.unionByName(sent(of_block, a + far + 1, (stretch + 1) * SPAN - 1 + far))
        whole = of_block.withColumn("_s", stretch).where((F.col("_s") + 1) * SPAN + far <= last)
        earlier = earlier.unionByName(sent(_pruned(whole, "_s"), (F.col("_s") + 1) * SPAN + far, last))
    later = rows.where(F.col("i") >= F.col("shortest") * (breaks + 1)).select("_k", "i", "s1", "s2", "shortest", block("i").alias("_b"))

    def least(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("i")
        length = right["i"].to_numpy()[:, None] - left["i"].to_numpy()[None, :]
        gap = right["s1"].to_numpy()[:, None] - left["s1"].to_numpy()[None, :]
        total = left["best"].to_numpy() + (right["s2"].to_numpy()[:, None] - left["s2"].to_numpy()) - gap * gap / np.maximum(length, 1)
        total[length < right["shortest"].to_numpy()[:, None]] = np.inf
        if not total.size:
            return pd.DataFrame({"_k": pd.Series([], dtype=object), "i": [], "best": [], "origin": []})
        at = total.argmin(axis=1)
        best = total[np.arange(len(at)), at]
        fine = np.isfinite(best)
        found = {"i": right["i"].to_numpy()[fine], "best": best[fine], "origin": left["i"].to_numpy()[at][fine]}
        names = pd.Series([str(right["_k"].iloc[0])] * int(fine.sum()), dtype=object)
        return pd.DataFrame({"_k": names, **found})

    found = earlier.groupBy("_k", "_b").cogroup(later.groupBy("_k", "_b")).applyInPandas(least, "_k string, i long, best double, origin long")
    return rows.join(found, ["_k", "i"])


def mean_breakpoints(
    daily: DataFrame, by: list[str], t: str, value: str, max_breaks: int = 5, h: float = 0.15
) -> DataFrame:
    """Segments of constant mean: ``segment``, first and last ``t``, rows and mean.

    Least-squares segmentation with at least ``h`` of the points (and two) per segment; BIC picks the number of breaks,
    fewer ones and earlier places on ties. One row per group and ``t`` is expected; null values take no part. Series
    may have any length: costs come from prefix sums, and each further break compares blocks of positions
    with the few earlier places that can still be the last break. The result is that of comparing all of them.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    points = daily.where(F.col(value).isNotNull()).select(
        key.alias("_g"), F.col(t).alias("_t"), F.col(value).cast("double").alias("_v")
    )
    shortest = F.greatest(F.floor(F.col("_n") * h), F.lit(2))
    name = F.to_json("_g", {"ignoreNullFields": "false"})
    rows = settle(_prefix_sums(points).withColumns({"shortest": shortest, "_k": name}), "prefix")
    whole = F.col("s2") - F.col("s1") * F.col("s1") / F.col("i")
    state = rows.select("*", whole.alias("best"), F.lit(0).cast("long").alias("origin"))
    states = [state]
    most = rows.agg(F.max("_n")).first()[0] or 0
    for breaks in range(1, max_breaks + 1):
        state = settle(_one_more_break(rows, state, breaks, most), "breaks")
        states.append(state)

    rss = F.greatest("best", F.lit(2.2250738585072014e-308))  # the least normal number: a perfect fit has no logarithm
    n = F.col("_n").cast("double")
    fits = None
    for breaks, state in enumerate(states):
        bic = n * F.log(rss) + F.log(n) * 2 * (breaks + 1)
        own = state.where("i = _n").select("_g", "_n", F.struct(bic.alias("bic"), F.lit(breaks).alias("m")).alias("_fit"))
        fits = own if fits is None else fits.unionByName(own)
    chosen = fits.groupBy("_g", "_n").agg(F.min("_fit").alias("_fit"))
    now = chosen.select("_g", F.col("_fit.m").alias("m"), F.col("_n").alias("i"))
    ends = now
    for breaks in range(max_breaks, 0, -1):
        step = now.join(states[breaks].select("_g", "i", "origin"), ["_g", "i"], "left")
        used = F.col("m") >= breaks
        now = step.select("_g", "m", F.when(used, F.col("origin")).otherwise(F.col("i")).alias("i"))
        ends = ends.unionByName(now.where(used))

    order = Window.partitionBy("_g").orderBy("i")  # a handful of segments per series
    at_end = ends.select("_g", "i").join(rows, ["_g", "i"]).withColumns(
        {
            "segment": F.row_number().over(order),
            "_from": F.coalesce(F.lag("i").over(order), F.lit(0)) + 1,
            "_before": F.coalesce(F.lag("s1").over(order), F.lit(0.0)),
        }
    )
    starts = rows.select("_g", F.col("i").alias("_from"), F.col("_t").alias("from_t"))
    points_in = F.col("i") - F.col("_from") + 1
    return at_end.join(starts, ["_g", "_from"]).select(
        *[F.col("_g")[c].alias(c) for c in by],
        "segment",
        "from_t",
        F.col("_t").alias("to_t"),
        points_in.alias("n_points"),
        (F.col("_mu") + (F.col("s1") - F.col("_before")) / points_in).alias("mean"),
    )


def break_intervals(
    daily: DataFrame, by: list[str], t: str, value: str, segments: DataFrame, level: float = 0.95
) -> DataFrame:
    """For each break of ``mean_breakpoints`` the earliest and the latest place that ``level`` allows for it.

    The error of a break's place has the distribution of the highest point of two drifting random walks, whose scales are the
    variances in the segments on both sides over the squared shift; both ends are found by halving, one row a break.
    Columns: ``by``, ``segment`` (the one that the break ends), ``shift``, ``lower_t``, ``place_t``, ``upper_t`` (``t`` of a last point
    before the break) and ``n_lower``, ``n_place``, ``n_upper`` (points up to it). Points are numbered by running counts over
    ranges, so no series is one task. Segments without any spread give the place itself.
    """

    @F.pandas_udf(DoubleType())
    def far(ratio: pd.Series) -> pd.Series:
        return pd.Series([reach((1 - level) / 2, float(r)) for r in ratio], dtype="float64")

    points = daily.where(F.col(value).isNotNull()).select(*by, F.col(t).alias("_t"), F.col(value).cast("double").alias("_v"))
    placed = assign_segments(points, segments, by, F.col("_t"))
    stats = placed.groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_s"))
    w = Window.partitionBy(*by).orderBy("segment")  # a handful of segments per series
    stats = stats.withColumns(
        {
            "n_place": F.sum("_n").over(w), "shift": F.lead("_m").over(w) - F.col("_m"), "_next": F.lead("_s").over(w),
            "_all": F.sum("_n").over(Window.partitionBy(*by)),
        }
    ).where("shift is not null")
    # A segment without spread counts as one with hardly any, so both scales stay finite.
    least = F.greatest("_s", "_next") * 1e-9
    a, b = F.greatest("_s", least), F.greatest("_next", least)
    square = F.col("shift") * F.col("shift")
    steps = lambda own, other: F.coalesce(F.ceil(far(F.try_divide(other, own)) * F.try_divide(own, square)), F.lit(0)).cast("long")
    found = settle(
        stats.select(
            *by, "segment", "shift", "n_place",
            F.when(b > 0, F.greatest(F.col("n_place") - steps(a, b), F.lit(1))).otherwise(F.col("n_place")).alias("n_lower"),
            F.when(b > 0, F.least(F.col("n_place") + steps(b, a), F.col("_all"))).otherwise(F.col("n_place")).alias("n_upper"),
        ),
        "intervals",
    )
    numbered = running_count(range_chunks(points, [*by, "_t"]), by, ["_t"], F.lit(1), "_i").select(*by, "_t", "_i")
    ends = ("lower", "place", "upper")
    asked = found.unpivot([*by, "segment"], [f"n_{e}" for e in ends], "_end", "_i")
    times = join_keep_left(asked, numbered, [*by, "_i"], "inner", null_safe=True).groupBy(*by, "segment").agg(
        *[F.max(F.when(F.col("_end") == f"n_{e}", F.col("_t"))).alias(f"{e}_t") for e in ends]
    )
    out = join_keep_left(found, times, [*by, "segment"], "inner", null_safe=True)
    return out.select(*by, "segment", "shift", *[f"{e}_t" for e in ends], *[f"n_{e}" for e in ends])


def assign_segments(df: DataFrame, segments: DataFrame, by: list[str], at: Column, name: str = "segment") -> DataFrame:
    """Number of the segment each row lies in.

    A segment reaches from its start up to the start of the next one, so no row is in two. The
    starts of a series travel as one short array: rows are not multiplied, and a hot series
    is a hot key on the left side only. ``segments`` comes from ``mean_breakpoints``, which bounds the array by
    its number of breaks.
    """
    starts = segments.groupBy(*by).agg(F.sort_array(F.collect_list("from_t")).alias("_starts"))
    found = attach(df.withColumn("_at", at), starts, by)
    number = F.size(F.filter("_starts", lambda s: s <= F.col("_at")))
    return found.withColumn(name, F.greatest(number, F.lit(1))).drop("_starts", "_at")
