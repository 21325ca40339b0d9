"""Non-linear least squares per group: each step is one grouped sum over all groups that have not settled."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seriesframe.operators.relate import attach, join_keep_left
from seriesframe.sources.files import settle

#: Damping at the start, and where a step is too small to be tried again.
DAMPING, STUCK = 1e-3, 1e14
#: Relative change of the parameters and of the sum of squares under which a group has settled.
STILL, LEVEL = 1e-9, 1e-13


@dataclass(frozen=True)
class Curve:
    """Names of the parameters, the value at x, its derivatives by the parameters, and starting values from grouped points.

    ``start(points, by)`` gets ``by``, ``x``, ``y``, ``n`` and returns ``by`` and the array ``start``.
    """

    names: tuple[str, ...]
    value: Callable[[Column, list[Column]], Column]
    slopes: Callable[[Column, list[Column]], list[Column]]
    start: Callable[[DataFrame, list[str]], DataFrame]


def _power_start(points: DataFrame, by: list[str]) -> DataFrame:
    """Line of ln y on ln x over positive points; a flat curve where there is none."""
    fine = (F.col("x") > 0) & (F.col("y") > 0)
    lx, ly = F.when(fine, F.log("x")), F.when(fine, F.log("y"))
    start = F.array(
        F.coalesce(F.exp(F.regr_intercept(ly, lx)), F.avg("y")), F.coalesce(F.regr_slope(ly, lx), F.lit(0.0))
    )
    return points.groupBy(*by).agg(start.alias("start"))


def _decay_start(points: DataFrame, by: list[str], from_rate: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Best of several rates, for each of which the other two parameters are a line: one pass for the range, one for the lines."""
    ends = points.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.avg("x").alias("_mx"))
    placed = attach(points, ends, by).withColumn("_span", F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)))
    fits = []
    for times in (0.25, 1.0, 4.0, 16.0):
        e = F.exp(-times * (F.col("x") - F.col("_lo")) / F.col("_span"))
        b = F.regr_slope("y", e)
        rss = F.regr_syy("y", e) - b * b * F.regr_sxx("y", e)
        fit = F.struct(rss.alias("rss"), F.regr_intercept("y", e).alias("a"), b.alias("b"), (times / F.max("_span")).alias("rate"))
        fits.append(F.when(b.isNotNull(), fit))
    best = placed.groupBy(*by).agg(
        F.array_min(F.filter(F.array(*fits), lambda f: f.isNotNull())).alias("_best"),
        F.max("_lo").alias("_lo"), F.max("_mx").alias("_mx"), F.avg("y").alias("_my"),
    )
    a, b = F.coalesce(F.col("_best.a"), F.col("_my")), F.coalesce(F.col("_best.b"), F.lit(0.0))
    start = from_rate(a, b, F.coalesce(F.col("_best.rate"), F.lit(1.0)), F.col("_lo"))
    return best.select(*by, start.alias("start"))


#: y = a x^b
POWER = Curve(
    ("a", "b"),
    lambda x, p: p[0] * F.pow(x, p[1]),
    lambda x, p: [F.pow(x, p[1]), F.when(x > 0, p[0] * F.pow(x, p[1]) * F.log(x)).otherwise(F.lit(0.0))],
    _power_start,
)


def _fade(x: Column, p: list[Column]) -> Column:
    return F.exp(-F.exp(p[2]) * x)


#: y = asymptote + (origin - asymptote) exp(-exp(log_rate) x)
ASYMPTOTE = Curve(
    ("asymptote", "origin", "log_rate"),
    lambda x, p: p[0] + (p[1] - p[0]) * _fade(x, p),
    lambda x, p: [1 - _fade(x, p), _fade(x, p), (p[0] - p[1]) * F.exp(p[2]) * x * _fade(x, p)],
    # The line's y = a + b exp(-rate (x - lo)) has its origin at x = 0.
    lambda points, by: _decay_start(points, by, lambda a, b, rate, lo: F.array(a, a + b * F.exp(F.least(rate * lo, F.lit(50.0))), F.log(rate))),
)


def plateau(at: float) -> Curve:
    """y = a + b exp(-c (x - at)): a curve that levels off, written around a given place."""

    def left(x: Column, p: list[Column]) -> Column:
        return F.exp(-p[2] * (x - at))

    return Curve(
        ("a", "b", "c"),
        lambda x, p: p[0] + p[1] * left(x, p),
        lambda x, p: [F.lit(1.0), left(x, p), -p[1] * (x - at) * left(x, p)],
        lambda points, by: _decay_start(
            points, by, lambda a, b, rate, lo: F.array(a, b * F.exp(F.least(rate * (lo - at), F.lit(50.0))), rate)
        ),
    )


def _next_trial(size: int) -> Callable:
    """Accept or refuse each group's trial, and make the next one."""
    i, j = np.triu_indices(size)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            matrix = lambda c, w: np.asarray(get(c).flatten(), np.float64).reshape(-1, w)
            number = lambda c: np.asarray(get(c).to_numpy(zero_copy_only=False), np.float64)
            width = len(i) + size
            base, trial, sums, new = matrix("base", size), matrix("trial", size), matrix("sums", width), matrix("new_sums", width)
            sse, new_sse, damping = number("sse"), number("new_sse"), number("damping")
            done, converged = (np.array(get(c).to_pylist(), bool) for c in ("done", "converged"))
            moved = np.abs(trial - base) / np.maximum(np.abs(trial), 1e-12)
            small = np.nan_to_num(moved, nan=np.inf).max(axis=1) <= STILL
            fine = np.isfinite(new_sse) & np.isfinite(new).all(axis=1)
            better = fine & (new_sse <= sse) & ~done
            still = better & (sse - new_sse <= LEVEL * new_sse) & np.isfinite(sse)
            converged |= ~done & ((still & small) | (~better & small & np.isfinite(sse)) | (better & (new_sse == 0)))
            base, sums = np.where(better[:, None], trial, base), np.where(better[:, None], new, sums)
            sse = np.where(better, new_sse, sse)
            damping = np.where(better, np.maximum(damping / 10, 1e-15), damping * 10)
            done = done | converged | (damping > STUCK)
            full = np.zeros((len(base), size, size))
            full[:, i, j] = full[:, j, i] = sums[:, : len(i)]
            own = np.einsum("bii->bi", full)
            lifted = full + damping[:, None, None] * np.eye(size) * np.where(own > 0, own, 1.0)[:, :, None]
            usable = np.isfinite(lifted).all(axis=(1, 2)) & np.isfinite(sums).all(axis=1)
            lifted[~usable] = np.eye(size)
            step = np.zeros_like(base)
            for row in range(len(base)):  # one small system each; a singular one is damped more in its next turn
                try:
                    step[row] = np.linalg.solve(lifted[row], sums[row, len(i) :])
                except np.linalg.LinAlgError:
                    damping[row] *= 10
            step[~usable] = 0.0
            lists = lambda a: pa.array(a.tolist(), pa.list_(pa.float64()))
            out = {"base": lists(base), "trial": lists(base + step), "sums": lists(sums), "sse": pa.array(sse), "damping": pa.array(damping)}
            out |= {"done": pa.array(done | ~usable), "converged": pa.array(converged)}
            keep = [c for c in batch.schema.names if c not in (*out, "new_sums", "new_sse", "steps")]
            steps = pa.array(get("steps").to_numpy() + ~np.array(get("done").to_pylist(), bool), pa.int64())
            columns = [*[get(c) for c in keep], *out.values(), steps]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *out, "steps"])

    return work


def fit_curve(df: DataFrame, by: list[str], y: str, x: str, curve: Curve, steps: int = 60) -> DataFrame:
    """Least-squares parameters of ``curve`` in each group by damped Gauss-Newton steps.

    Rows with equal x in a group are summed up first (their mean, number and spread hold all a fit needs). A step joins each
    group's trial parameters to its points, sums up J'J, J'r and the squares in one grouped aggregate, and makes the next
    trials from the sums alone; groups that have settled leave the join. At most ``steps`` steps: a group that has not settled by then,
    or whose curve is not determined by its points, keeps its best parameters with ``converged`` false; nothing raises an error.

    Columns: ``by``, the parameters, their standard errors ``se_...`` (null where the curve is not determined), ``n`` rows, ``sse``,
    ``r2_max`` (likelihood gain over the mean alone, as a part of its largest possible value after Nagelkerke), ``steps``, ``converged``.
    Rows with a missing x or y take no part, and neither do groups without any; missing keys form a group of their own.
    """
    size = len(curve.names)
    width = size * (size + 1) // 2 + size
    value = lambda c: F.col(c).cast("double")
    rows = df.select(*by, value(x).alias("x"), value(y).alias("y")).dropna(subset=["x", "y"])
    count = F.count(F.lit(1))
    points = rows.groupBy(*by, "x").agg(count.alias("n"), F.avg("y").alias("y"), (F.var_pop("y") * count).alias("within"))
    points = settle(points, "points")
    means = points.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("_mean"))
    off = F.col("y") - F.col("_mean")
    around = attach(points, means.select(*by, "_mean"), by)
    total = around.groupBy(*by).agg(F.sum(F.col("n") * off * off + F.col("within")).alias("tss"))
    state = attach(attach(means.drop("_mean"), total, by), curve.start(points, by), by)
    state = state.select(
        *by, "n", "tss", F.col("start").alias("base"), F.col("start").alias("trial"), F.array_repeat(F.lit(0.0), width).alias("sums"),
        F.lit(float("inf")).alias("sse"), F.lit(DAMPING).alias("damping"), F.lit(False).alias("done"), F.lit(False).alias("converged"),
        F.lit(0).cast("long").alias("steps"),
    )
    state = settle(state, "fits")
    shape = state.schema
    p = [F.col("trial")[k] for k in range(size)]
    slopes = curve.slopes(F.col("x"), p)
    r, n = F.col("y") - curve.value(F.col("x"), p), F.col("n")
    products = [F.sum(n * a * b) for k, a in enumerate(slopes) for b in slopes[k:]] + [F.sum(n * a * r) for a in slopes]
    for _ in range(steps):
        active = state.where("not done")
        placed = join_keep_left(points, active.select(*by, "trial"), by, "inner", null_safe=True) if by else attach(points, active.select("trial"), [])
        sums = placed.groupBy(*by).agg(F.array(*products).alias("new_sums"), F.sum(n * r * r + F.col("within")).alias("new_sse"))
        tried = attach(active, sums, by).mapInArrow(_next_trial(size), shape)
        state = settle(tried.unionByName(state.where("done")), "fits")
        if state.where("not done").isEmpty():
            break

    names = [*curve.names, *[f"se_{c}" for c in curve.names]]
    out = StructType([*[shape[b] for b in by], shape["n"], shape["tss"], *[StructField(c, DoubleType()) for c in names], shape["sse"], shape["steps"], shape["converged"]])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            base, sums = (np.asarray(get(c).flatten(), np.float64).reshape(batch.num_rows, -1) for c in ("base", "sums"))
            n, sse = (np.asarray(get(c).to_numpy(zero_copy_only=False), np.float64) for c in ("n", "sse"))
            errors = np.full(base.shape, np.nan)
            for row in range(len(base)):
                full = np.zeros((size, size))
                full[i, j] = full[j, i] = sums[row, : len(i)]
                scale = np.sqrt(np.diag(full))
                if n[row] > size and np.isfinite(full).all() and (scale > 0).all() and np.linalg.cond(full / np.outer(scale, scale)) < 1e12:
                    errors[row] = np.sqrt(np.diag(np.linalg.inv(full / np.outer(scale, scale))) * sse[row] / (n[row] - size)) / scale
            known = lambda v: pa.array(np.where(np.isfinite(v), v, np.nan), pa.float64(), from_pandas=True)
            columns = [*[get(c) for c in [*by, "n", "tss"]], *map(known, base.T), *map(known, errors.T), known(sse), get("steps"), get("converged")]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    fits = state.mapInArrow(finish, out)
    # Likelihoods of the mean alone and of the curve, both over n.
    share = lambda rss: F.log(2 * math.pi * rss / F.col("n")) + 1
    gain = (1 - F.exp(share(F.col("sse")) - share(F.col("tss")))) / (1 - F.exp(-share(F.col("tss"))))
    r2 = F.when((F.col("tss") > 0) & (F.col("sse") > 0), gain)
    return fits.withColumn("r2_max", r2).select(*by, *names, "n", "sse", "r2_max", "steps", "converged")
