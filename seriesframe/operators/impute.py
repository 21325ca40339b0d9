"""Filling missing values of gridded series, and multiple imputation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.operators.median import grouped_median
from seriesframe.operators.relate import attach, join_keep_left
from seriesframe.operators.running import running_total
from seriesframe.operators.scan import CHUNK, nearest_observed, range_chunks, running_count


def impute_mean(df: DataFrame, by: list[str], value: str, name: str = "filled") -> DataFrame:
    """Missing values become the group mean."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return attach(df, stats, by).withColumn(name, F.coalesce(value, "_mean")).drop("_mean")


def impute_median(df: DataFrame, by: list[str], value: str, name: str = "filled") -> DataFrame:
    """Missing values become the exact group median.

    With a segment and a time-of-day slot in ``by`` this is the "median time block" fill.
    """
    stats = grouped_median(df, by, value, "_med")
    return attach(df, stats, by).withColumn(name, F.coalesce(F.col(value), F.col("_med"))).drop("_med")


def impute_linear(
    df: DataFrame, by: list[str], slot: str, value: str, name: str = "filled", size: int = CHUNK
) -> DataFrame:
    """Straight line between the neighbouring observations; the ends keep the nearest value."""
    near = nearest_observed(df, by, slot, value, size)
    weight = (F.col(slot) - F.col("prev_slot")) / (F.col("next_slot") - F.col("prev_slot"))
    line = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * weight
    inside = F.when(F.col("next_slot") > F.col("prev_slot"), line)
    return near.select(
        *df.columns, F.coalesce(F.col(value), inside, F.col("prev_value"), F.col("next_value")).alias(name)
    )


def impute_seasonal(
    df: DataFrame, by: list[str], slot: str, value: str, period: int, name: str = "filled", size: int = CHUNK
) -> DataFrame:
    """Take the seasonal means out, fill the rest by a line, put the seasonal means back.

    A season position without any observation has seasonal effect 0.
    """
    placed = df.withColumn("_pos", F.pmod(F.col(slot), F.lit(period)))
    level = placed.groupBy(*by).agg(F.avg(value).alias("_level"))
    season = placed.groupBy(*by, "_pos").agg(F.avg(value).alias("_smean"))
    both = attach(attach(placed, level, by), season, [*by, "_pos"])
    both = both.withColumn("_season", F.coalesce(F.col("_smean") - F.col("_level"), F.lit(0.0)))
    both = both.withColumn("_rest", F.col(value) - F.col("_season"))
    filled = impute_linear(both, by, slot, "_rest", "_rest_filled", size)
    return filled.select(
        *df.columns, F.coalesce(F.col(value), F.col("_rest_filled") + F.col("_season")).alias(name)
    )


def regression_stats(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Least-squares line of each group over rows with both values, with residual sd."""
    slope, intercept = F.regr_slope(y, x), F.regr_intercept(y, x)
    n = F.regr_count(y, x)
    rss = F.regr_syy(y, x) - slope * slope * F.regr_sxx(y, x)
    return df.groupBy(*by).agg(
        slope.alias("_b"),
        intercept.alias("_a"),
        F.when(n > 2, F.sqrt(F.greatest(rss, F.lit(0.0)) / (n - 2))).alias("_s"),
    )


def impute_regression(df: DataFrame, by: list[str], y: str, x: str, name: str = "filled") -> DataFrame:
    """Missing values become the value of the group's regression line."""
    fits = regression_stats(df, by, y, x).drop("_s")
    out = attach(df, fits, by)
    return out.withColumn(name, F.coalesce(F.col(y), F.col("_a") + F.col("_b") * F.col(x))).drop("_a", "_b")


def hash_uniform(*parts: Column | str) -> Column:
    """Number in (0, 1) from an md5 of the parts: the same on every engine, task and retry.

    A missing part counts as a text of its own, so it cannot be mistaken for another key pattern.
    """
    columns = [p if isinstance(p, Column) else F.col(p) for p in parts]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return (word + F.lit(0.5)) / F.lit(4294967296.0)


def hash_normal(*parts: Column | str) -> Column:
    """Standard normal number from two hashed uniforms: the same on every engine, task and retry."""
    radius = F.sqrt(-2 * F.log(hash_uniform(*parts, F.lit("r"))))
    return radius * F.cos(2 * math.pi * hash_uniform(*parts, F.lit("a")))


def impute_norm_drawn(
    df: DataFrame, by: list[str], y: str, x: str, row_id: str, m: int = 5, seed: int = 1, name: str = "filled"
) -> DataFrame:
    """``m`` completed copies, each from a regression of its own: variance, slope and level are drawn from their posterior.

    The residual variance is the estimate times k / chi-square(k), k = n - 2, the chi-square number from a normal one by
    the cube-root approximation; slope and mean level are drawn around their estimates with that variance. So
    the copies differ by what is not known about the line, too, and pooling sees it.
    """
    known = F.col(y).isNotNull() & F.col(x).isNotNull()
    more = df.where(known).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.regr_sxx(y, x).alias("_sxx")
    )
    fits = attach(regression_stats(df, by, y, x), more, by)
    fits = fits.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(m))))
    group = [*by, "m", F.lit(str(seed))]
    k = F.col("_n") - 2
    spread = F.lit(2.0) / (9 * k)
    chi = k * F.pow(1 - spread + hash_normal(*group, F.lit("v")) * F.sqrt(spread), F.lit(3.0))
    fits = fits.withColumn("_sd", F.when(k > 0, F.col("_s") * F.sqrt(k / F.greatest(chi, F.lit(1e-9)))))
    fits = fits.withColumns(
        {
            "_slope": F.col("_b") + hash_normal(*group, F.lit("b")) * F.try_divide(F.col("_sd"), F.sqrt("_sxx")),
            "_level": F.col("_my") + hash_normal(*group, F.lit("c")) * F.col("_sd") / F.sqrt("_n"),
        }
    ).select(*by, "m", "_sd", "_slope", "_level", "_mx")
    copies = df.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(m))))
    out = attach(copies, fits, [*by, "m"])
    noise = hash_normal(*by, row_id, "m", F.lit(str(seed)))
    drawn = F.col("_level") + F.col("_slope") * (F.col(x) - F.col("_mx")) + F.col("_sd") * noise
    return out.withColumn(name, F.coalesce(F.col(y), drawn)).drop("_sd", "_slope", "_level", "_mx")


def impute_norm(
    df: DataFrame, by: list[str], y: str, x: str, row_id: str, m: int = 5, seed: int = 1, name: str = "filled"
) -> DataFrame:
    """``m`` completed copies: regression value plus normal noise of the residual sd."""
    out = attach(df, regression_stats(df, by, y, x), by)
    out = out.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(m))))
    key = [*[F.col(c).cast("string") for c in [*by, row_id, "m"]], F.lit(str(seed))]
    noise = hash_normal(*key)
    drawn = F.col("_a") + F.col("_b") * F.col(x) + F.col("_s") * noise
    return out.withColumn(name, F.coalesce(F.col(y), drawn)).drop("_a", "_b", "_s")


def impute_pmm(
    df: DataFrame,
    by: list[str],
    y: str,
    x: str,
    row_id: str,
    k: int = 5,
    m: int = 5,
    seed: int = 1,
    name: str = "filled",
    parts: int | None = None,
    digits: int = 9,
) -> DataFrame:
    """Predictive mean matching: ``m`` draws per missing value from its ``k`` nearest donors.

    Donors are rows with ``y``, compared by regression value. They are ranked in order of
    (regression value, id). A missing row looks at the k donors at or before its own place
    and the k after it, which hold the k nearest for certain; distances equal to ``digits``
    decimals go to the lower rank. The 2k candidates of a place are fetched once by an equality
    join on the rank, however many missing rows share the place. Result: observed rows ``m``
    times, and the drawn rows.
    """
    fits = regression_stats(df, by, y, x).drop("_s")
    fitted = attach(df, fits, by).withColumn("_pred", F.col("_a") + F.col("_b") * F.col(x))
    fitted = fitted.select(*by, row_id, y, "_pred")
    copies = F.explode(F.sequence(F.lit(1), F.lit(m)))
    drawn = donor_draws(fitted, by, y, row_id, k, copies, [*by, row_id, "m"], seed, parts, digits)
    observed = df.where(F.col(y).isNotNull()).withColumn("m", copies)
    observed = observed.withColumn(name, F.col(y))
    missing = df.where(F.col(y).isNull()).withColumn("m", copies)
    missing = join_keep_left(missing, drawn, [*by, row_id, "m"], "left", null_safe=True)
    missing = missing.withColumn(name, F.col("_draw")).drop("_draw")
    return observed.unionByName(missing)


def donor_draws(
    fitted: DataFrame, by: list[str], y: str, row_id: str, k: int, copies: Column | None, key: list[str], seed: int | str,
    parts: int | None = None, digits: int = 9,
) -> DataFrame:
    """``by``, ``row_id``, (``m``) and ``_draw``: a hashed draw among the ``k`` donors nearest in ``_pred`` for each missing ``y``."""
    chunked = range_chunks(fitted, [*by, "_pred", row_id], parts)
    ranked = running_count(chunked, by, ["_pred", row_id], F.col(y).isNotNull(), "_rank")
    donors = ranked.where(F.col(y).isNotNull()).select(
        *by, F.col("_rank").alias("_dr"), F.struct(F.col("_rank").alias("r"), F.col("_pred").alias("p"), F.col(y).alias("y")).alias("_donor")
    )
    need = ranked.where(F.col(y).isNull()).select(*by, row_id, "_pred", "_rank")
    places = need.select(*by, "_rank").distinct()
    asked = places.select(
        *by, "_rank", F.explode(F.sequence(F.col("_rank") - (k - 1), F.col("_rank") + k)).alias("_dr")
    )
    pools = join_keep_left(asked, donors, [*by, "_dr"], "inner", null_safe=True)
    pools = pools.groupBy(*by, "_rank").agg(F.collect_list("_donor").alias("_pool"))
    distance = lambda d: F.round(F.abs(d["p"] - F.col("_pred")), digits)
    by_distance = F.transform("_pool", lambda d: F.struct(distance(d).alias("d"), d["r"].alias("r"), d["y"].alias("y")))
    near = attach(need, pools, [*by, "_rank"]).withColumn("_pool", F.slice(F.sort_array(by_distance), 1, k))
    drawn = near if copies is None else near.withColumn("m", copies)
    place = F.floor(hash_uniform(*[F.col(c).cast("string") for c in key], F.lit(str(seed))) * F.size("_pool")).cast("int")
    extra = [] if copies is None else ["m"]
    return drawn.select(*by, row_id, *extra, F.get(F.col("_pool"), place)["y"].alias("_draw"))


def pool_estimates(completed: DataFrame, by: list[str], y: str, x: str, m: str = "m") -> DataFrame:
    """Slope of each completed copy, pooled: mean, within, between and total variance."""
    slope, n = F.regr_slope(y, x), F.regr_count(y, x)
    rss = F.regr_syy(y, x) - slope * slope * F.regr_sxx(y, x)
    fits = completed.groupBy(*by, m).agg(
        slope.alias("_q"), (rss / (n - 2) / F.regr_sxx(y, x)).alias("_u")
    )
    pooled = fits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("m_copies"),
        F.avg("_q").alias("estimate"),
        F.avg("_u").alias("within_var"),
        F.var_samp("_q").alias("between_var"),
    )
    total = F.col("within_var") + (1 + 1 / F.col("m_copies")) * F.col("between_var")
    return pooled.withColumn("total_var", total)


def compare_daily(
    df: DataFrame, by: list[str], date: Column, raw: str, filled: str
) -> DataFrame:
    """Daily means before and after filling, and their running sums by group."""
    daily = df.groupBy(*by, date.alias("date")).agg(
        F.avg(raw).alias("raw_mean"), F.avg(filled).alias("filled_mean")
    )
    long = daily.unpivot([*by, "date"], ["raw_mean", "filled_mean"], "kind", "value")
    return running_total(long, "date", "value", [*by, "kind"], "cum_value")
