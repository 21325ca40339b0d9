"""Local regression: smooth lines along a series, and a decomposition whose trend and season move over time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seriesframe.operators.impute import impute_linear
from seriesframe.operators.relate import attach
from seriesframe.operators.scan import CHUNK, chunk_key, with_halo

#: A window whose squared spread is under this part of its largest possible one holds a single place: no slope.
FLAT = 1e-9


def tricube(reach: int) -> list[float]:
    """Weights of the places -reach..reach; the place after the last one has weight 0."""
    return [(1 - (abs(j) / (reach + 1)) ** 3) ** 3 for j in range(-reach, reach + 1)]


def local_line(y: np.ndarray, reach: int, step: int = 1) -> np.ndarray:
    """Value at each place of the weighted straight line through the places up to ``reach`` steps away.

    Missing values (not-a-number) have no weight; a window with values at one place only takes its value, an empty one
    is missing. Terms are added in the order of the places, so a value does not depend on where an array begins.
    """
    pad, n = reach * step, len(y)
    known = np.pad(~np.isnan(y), pad).astype(np.float64)
    value = np.pad(np.where(np.isnan(y), 0.0, y), pad)
    s0, s1, s2, t0, t1 = np.zeros((5, n))
    for j, w in zip(range(-reach, reach + 1), tricube(reach)):
        at = slice(pad + j * step, pad + j * step + n)
        a, b = w * known[at], w * value[at]
        s0 += a
        s1 += j * a
        s2 += j * j * a
        t0 += b
        t1 += j * b
    spread = s0 * s2 - s1 * s1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > FLAT * s0 * s2, (s2 * t0 - s1 * t1) / spread, t0 / s0)


def low_pass(period: int) -> np.ndarray:
    """Weights of two moving averages over a period and one over three places, one after the other."""
    one = np.full(period, 1.0 / period)
    return np.convolve(np.convolve(one, one), np.full(3, 1.0 / 3))


def _mean_of_known(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean over the known places around each place."""
    known = ~np.isnan(y)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.convolve(np.where(known, y, 0.0), weights, "same") / np.convolve(known, weights, "same")


def decomposed(y: np.ndarray, first: int, last: int, period: int, season: int, low: int, trend: int, rounds: int) -> tuple:
    """Trend and season at each place of ``y``; the series itself reaches from place ``first`` to ``last``.

    Each round takes the trend off, smooths the places of equal season position along the cycles (carried on for
    one period over both ends), takes what is slow in it off again, and smooths what is left without the season.
    """
    place = np.arange(len(y))
    inside, near = (place >= first) & (place <= last), (place >= first - period) & (place <= last + period)
    level, seasonal, weights = np.zeros(len(y)), np.zeros(len(y)), low_pass(period)
    for _ in range(rounds):
        cycles = local_line(np.where(inside, y - level, np.nan), season, period)
        slow = _mean_of_known(np.where(near, cycles, np.nan), weights)
        slow = local_line(np.where(inside, slow, np.nan), low)
        seasonal = np.nan_to_num(cycles - slow, nan=0.0)
        level = local_line(np.where(inside, y - seasonal, np.nan), trend)
    return level, seasonal


def decompose_local(
    df: DataFrame,
    by: list[str],
    slot: str,
    value: str,
    period: int,
    season: int = 5,
    trend: int | None = None,
    low: int | None = None,
    rounds: int = 2,
    size: int = CHUNK,
) -> DataFrame:
    """Add ``trend``, ``seasonal`` and ``remainder`` from local lines with tricube weights.

    ``season`` is the reach along the cycles (in periods), ``trend`` and ``low`` the reach of the trend and of the slow part
    that the season gives up (in slots; by default the usual ones for the period). ``df`` has one row per slot of a series,
    missing values among them; a slot without a value has a trend and a season, too, where its windows hold
    values, and a season of 0 otherwise.

    What a slot gets depends on slots a fixed reach away, so a series is cut into chunks that overlap by the reach of all
    rounds together: one shuffle, no series in one task, and values that do not depend on the cut.
    """
    low = period // 2 if low is None else low
    if trend is None:
        trend = int(np.ceil(1.5 * period / (1 - 1.5 / (2 * season + 1)))) // 2
    reach = rounds * (season * period + period + low + trend)
    ends = df.groupBy(*by).agg(F.min(slot).alias("_lo"), F.max(slot).alias("_hi"))
    halo = with_halo(attach(df, ends, by), slot, reach, max(size, 2 * reach + 1))
    halo = halo.withColumns({"_key": chunk_key(by), "_value": F.col(value).cast("double")})
    added = [StructField("trend", DoubleType()), StructField("seasonal", DoubleType())]
    shape = StructType([*halo.schema.fields, *added])

    def one_chunk(rows: pa.Table) -> pa.Table:
        at = rows[slot].to_numpy().astype(np.int64)
        start = at.min() - period
        y = np.full(at.max() + period - start + 1, np.nan)
        y[at - start] = rows["_value"].to_numpy()
        lo, hi = (rows[c][0].as_py() - int(start) for c in ("_lo", "_hi"))
        level, seasonal = decomposed(y, lo, hi, period, season, low, trend, rounds)
        known = lambda x: pa.array(x[at - start], pa.float64(), from_pandas=True)
        out = rows.append_column("trend", known(level)).append_column("seasonal", known(seasonal))
        return out.filter(rows["_home"])

    out = halo.groupBy("_key").applyInArrow(one_chunk, shape)
    return out.select(*df.columns, "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("remainder"))


def impute_local_season(
    df: DataFrame, by: list[str], slot: str, value: str, period: int, name: str = "filled", size: int = CHUNK, **how
) -> DataFrame:
    """Take the moving season off, fill the rest by a line, put the season back."""
    parts = decompose_local(df, by, slot, value, period, size=size, **how)
    parts = parts.withColumn("_rest", F.col(value) - F.col("seasonal"))
    filled = impute_linear(parts, by, slot, "_rest", "_rest_filled", size)
    return filled.select(*df.columns, F.coalesce(F.col(value), F.col("_rest_filled") + F.col("seasonal")).alias(name))
