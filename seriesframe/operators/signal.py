"""Autocorrelation, AR(1), trend and classical decomposition of gridded series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seriesframe.functions.tails import t_quantile
from seriesframe.operators.relate import attach
from seriesframe.operators.scan import CHUNK, chunk_key, with_halo


def autocorrelation(
    df: DataFrame, by: list[str], slot: str, value: str, max_lag: int, size: int = CHUNK
) -> DataFrame:
    """Autocorrelation at lags 1..``max_lag``; pairs with a missing value are left out.

    ``df`` has one row per slot. Chunks overlap by ``max_lag`` slots, so all lags come from
    one pass of windows inside chunks and one partial aggregate.
    """
    mean = df.groupBy(*by).agg(F.avg(value).alias("_mu"))
    centred = attach(df, mean, by).withColumn("_d", F.col(value) - F.col("_mu")).select(*by, slot, "_d")
    halo = with_halo(centred, slot, max_lag, size)
    w = Window.partitionBy(chunk_key(by)).orderBy(slot)
    lagged = halo.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)})
    sums = lagged.where("_home").groupBy(*by).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_c0"),
        *[F.sum(F.col("_d") * F.col(f"_d{k}")).alias(str(k)) for k in range(1, max_lag + 1)],
    )
    long = sums.unpivot([*by, "_c0"], [str(k) for k in range(1, max_lag + 1)], "lag", "_ck")
    return long.select(*by, F.col("lag").cast("int").alias("lag"), F.try_divide("_ck", "_c0").alias("acf"))


def ar1_fit(df: DataFrame, by: list[str], slot: str, value: str, size: int = CHUNK) -> DataFrame:
    """First-order autoregression by conditional least squares: phi, mean, innovation variance."""
    halo = with_halo(df.select(*by, slot, F.col(value).alias("_x")), slot, 1, size)
    w = Window.partitionBy(chunk_key(by)).orderBy(slot)
    pairs = halo.withColumn("_p", F.lag("_x").over(w)).where("_home")
    phi, c, n = F.regr_slope("_x", "_p"), F.regr_intercept("_x", "_p"), F.regr_count("_x", "_p")
    rss = F.regr_syy("_x", "_p") - phi * phi * F.regr_sxx("_x", "_p")
    return pairs.groupBy(*by).agg(
        n.alias("n_pairs"), phi.alias("phi"), (c / (1 - phi)).alias("mean"), (rss / n).alias("sigma2")
    )


def trend_forecast(df: DataFrame, by: list[str], idx: str, value: str, horizon: int) -> DataFrame:
    """Straight trend over the row number, continued for ``horizon`` steps."""
    fits = df.groupBy(*by).agg(
        F.regr_slope(value, idx).alias("slope"),
        F.regr_intercept(value, idx).alias("intercept"),
        F.max(idx).alias("_n"),
    )
    steps = F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + horizon)).alias("idx")
    ahead = fits.select(*by, "slope", "intercept", steps)
    return ahead.withColumn("forecast", F.col("intercept") + F.col("slope") * F.col("idx"))


def forecast_bounds(df: DataFrame, by: list[str], idx: str, value: str, horizon: int, levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """``trend_forecast`` with the bounds that hold a new value with each probability, ``lower_80``, ``upper_80`` and so on.

    Fewer than three values give a forecast without bounds.
    """
    n, sxx, slope = F.regr_count(value, idx).cast("double"), F.regr_sxx(value, idx), F.regr_slope(value, idx)
    rss = F.greatest(F.regr_syy(value, idx) - slope * slope * sxx, F.lit(0.0))
    spread = df.groupBy(*by).agg(n.alias("_n"), sxx.alias("_sxx"), F.regr_avgx(value, idx).alias("_mx"), rss.alias("_rss"))
    # One quantile for each series, before the steps ahead multiply the rows.
    spread = spread.withColumns({f"_t{k}": t_quantile(1 - p, F.col("_n") - 2) for k, p in enumerate(levels)})
    out = attach(trend_forecast(df, by, idx, value, horizon), spread, by)
    off = F.col("idx") - F.col("_mx")
    variance = F.when(F.col("_n") > 2, F.col("_rss") / (F.col("_n") - 2) * (1 + 1 / F.col("_n") + F.try_divide(off * off, F.col("_sxx"))))
    bounds = {}
    for k, p in enumerate(levels):
        reach = F.col(f"_t{k}") * F.sqrt(variance)
        bounds |= {f"lower_{round(100 * p)}": F.col("forecast") - reach, f"upper_{round(100 * p)}": F.col("forecast") + reach}
    return out.withColumns(bounds).drop("_n", "_sxx", "_mx", "_rss", *[f"_t{k}" for k in range(len(levels))])


def centred_average(
    df: DataFrame, by: list[str], slot: str, value: str, period: int, name: str = "trend", size: int = CHUNK
) -> DataFrame:
    """Centred moving average; even periods take the two outer values at half weight.

    Null where the window runs over an end of the series or meets a missing value.
    """
    reach = period // 2
    halo = with_halo(df, slot, reach, size)
    w = Window.partitionBy(chunk_key(by)).orderBy(slot)
    frame = w.rowsBetween(-reach, reach)
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(value, reach).over(w) + F.lead(value, reach).over(w)) / 2
    whole = F.count(value).over(frame) == 2 * reach + 1
    out = halo.withColumn(name, F.when(whole, total / period))
    return out.where("_home").drop("_chunk", "_home")


def decompose_additive(
    df: DataFrame, by: list[str], slot: str, value: str, period: int, size: int = CHUNK
) -> DataFrame:
    """Trend, seasonal effect (means over the season position, centred) and remainder."""
    with_trend = centred_average(df, by, slot, value, period, "trend", size)
    first = df.groupBy(*by).agg(F.min(slot).alias("_lo"))
    placed = attach(with_trend, first, by).withColumn("_pos", (F.col(slot) - F.col("_lo")) % period)
    effects = placed.groupBy(*by, "_pos").agg(F.avg(F.col(value) - F.col("trend")).alias("_eff"))
    centre = effects.groupBy(*by).agg(F.avg("_eff").alias("_centre"))
    effects = attach(effects, centre, by).withColumn("seasonal", F.col("_eff") - F.col("_centre")).drop("_eff", "_centre")
    out = attach(placed, effects, [*by, "_pos"])
    return out.withColumn("remainder", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_lo", "_pos")
