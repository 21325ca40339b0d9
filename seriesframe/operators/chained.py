"""Multiple imputation of several incomplete columns, each from all the others in turn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from seriesframe.operators.impute import donor_draws, hash_normal
from seriesframe.operators.normal import DOUBLE, DOUBLES, LONG, each_group, field, gram, regress, sweep
from seriesframe.operators.relate import attach, join_keep_left
from seriesframe.sources.files import settle

METHODS = ("predict", "norm", "pmm")


def _fits(rows: DataFrame, group: list[str], y: str, xs: list[str]) -> DataFrame:
    """Per group: rows, mean level, slopes, predictor means, residual spread, and the factor by which slopes vary together."""
    grams = gram(rows, group, {y: F.col(y)} | {x: F.col(x) for x in xs})
    places = list(range(1, len(xs) + 1))

    def solve(n: np.ndarray, m: np.ndarray, c: np.ndarray):
        slopes, rss, used = regress(c, 0, places)
        inverse = c[:, 1:, 1:].copy()
        sweep(inverse, list(range(len(xs))))
        factor = np.zeros_like(inverse)
        for row in range(len(n)):  # one small matrix a group; terms that follow from others have no share
            keep = np.flatnonzero(used[row])
            block = inverse[row][np.ix_(keep, keep)]
            factor[row][np.ix_(keep, keep)] = np.linalg.cholesky((block + block.T) / 2) if len(keep) else 0.0
        free = n - 1 - used.sum(axis=1)
        spread = np.where(free > 0, np.sqrt(rss / np.maximum(free, 1)), 0.0)
        yield [n.astype(np.int64), m[:, 0], list(slopes), list(m[:, 1:]), spread, np.maximum(free, 0).astype(np.int64), [f.ravel() for f in factor]]

    fields = [("_n", LONG), ("_level", DOUBLE), ("_slopes", DOUBLES), ("_means", DOUBLES), ("_sd", DOUBLE), ("_free", LONG), ("_factor", DOUBLES)]
    return each_group(grams, group, StructType([field(*f) for f in fields]), solve)


def _drawn(fits: DataFrame, group: list[str], count: int, tag: Column) -> DataFrame:
    """Spread, level and slopes drawn from what the fit leaves open, by hashed numbers: the variance is the estimate times
    k / chi-square(k) (by the cube-root approximation), level and slopes vary around their estimates with it."""
    number = lambda what: hash_normal(*group, tag, F.lit(what))
    k = F.col("_free").cast("double")
    part = F.try_divide(F.lit(2.0), 9 * k)
    chi = k * F.pow(1 - part + number("v") * F.sqrt(part), F.lit(3.0))
    fits = fits.withColumn("_sd", F.when(k > 0, F.col("_sd") * F.sqrt(k / F.greatest(chi, F.lit(1e-9)))).otherwise(F.lit(0.0)))
    fits = fits.withColumns({f"_z{i}": number(f"b{i}") for i in range(count)})
    moved = [
        F.col("_slopes")[i] + F.col("_sd") * sum((F.col("_factor")[i * count + j] * F.col(f"_z{j}") for j in range(i + 1)), F.lit(0.0))
        for i in range(count)
    ]
    level = F.col("_level") + number("c") * F.col("_sd") / F.sqrt("_n")
    return fits.select(*group, "_sd", level.alias("_level"), F.array(*moved).alias("_slopes"), "_means")


def impute_chained(
    df: DataFrame,
    by: list[str],
    columns: list[str],
    predictors: list[str],
    row_id: str,
    m: int = 5,
    rounds: int = 5,
    method: str = "norm",
    seed: int = 1,
    k: int = 5,
) -> DataFrame:
    """``m`` completed copies of the rows, in which each of ``columns`` was filled from all the others, ``rounds`` times over.

    Missing values start as their group's mean. Then the columns take turns: a column is regressed, per group and copy,
    on the other columns as they stand and on ``predictors``, over the rows where it was observed, and its
    missing values are replaced: by the regression value (``predict``), by that of a drawn regression plus noise
    (``norm``), or by an observed value among the ``k`` nearest in regression value of a drawn regression (``pmm``).
    All draws are hashes of group, copy, row, column, turn and seed, so reruns agree.

    A turn is one grouped sum of cross products and one join of the groups' coefficients; the state is written after it, so no
    turn works the earlier ones out again. Columns: those of ``df`` and ``m``; observed values stay as they are, and what no
    group mean exists for stays missing. Rows that lack a predictor are not filled beyond the mean. Missing keys form a
    group of their own; ``row_id`` is unique inside a group.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    group = [*by, "m"]
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    start = attach(df, means, by).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(m))))
    state = start.select(
        *df.columns, "m", *[F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")).alias(f"_now_{c}") for c in columns]
    )
    state = settle(state, "chained")
    shape = state.columns
    for turn in range(rounds):
        for y in columns:
            xs = [*[f"_now_{c}" for c in columns if c != y], *predictors]
            tag = F.lit(f"{seed}/{turn}/{y}")
            seen = state.where(F.col(y).isNotNull())
            fits = _fits(seen, group, f"_now_{y}", xs)
            used = fits.select(*group, "_sd", "_level", "_slopes", "_means") if method == "predict" else _drawn(fits, group, len(xs), tag)
            rows = attach(state, used, group)
            value = F.col("_level") + sum((F.col("_slopes")[i] * (F.col(x) - F.col("_means")[i]) for i, x in enumerate(xs)), F.lit(0.0))
            if method == "pmm":
                fitted = rows.select(*group, row_id, F.col(y).cast("double").alias("_y"), value.alias("_pred")).where("_pred is not null")
                draws = donor_draws(fitted, group, "_y", row_id, k, None, [*group, row_id], f"{seed}/{turn}/{y}")
                rows = join_keep_left(state, draws, [*group, row_id], "left", null_safe=True)
                new = F.col("_draw")
            else:
                noise = F.col("_sd") * hash_normal(*group, row_id, tag) if method == "norm" else F.lit(0.0)
                new = value + noise
            filled = F.when(F.col(y).isNull(), F.coalesce(new, F.col(f"_now_{y}"))).otherwise(F.col(f"_now_{y}"))
            state = settle(rows.withColumn(f"_now_{y}", filled).select(*shape), "chained")
    return state.select(*[F.col(f"_now_{c}").alias(c) if c in columns else F.col(c) for c in df.columns], "m")
