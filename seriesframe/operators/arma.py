"""Order search for autoregressive moving averages, and models with several predictors and autocorrelated errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from seriesframe.operators.normal import DOUBLE, DOUBLES, LONG, TEXT, each_group, field, gram, information, regress
from seriesframe.operators.scan import CHUNK, chunk_key, with_halo


def lagged(df: DataFrame, by: list[str], slot: str, terms: dict[str, Column], lags: int, size: int = CHUNK) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with each term and its values up to ``lags`` slots before, named ``term.lag``.

    ``df`` has one row per slot. Chunks overlap by the lags, so all copies come from windows inside chunks.
    """
    names = {t: f"_x{k}" for k, t in enumerate(terms)}
    rows = df.select(*by, slot, *[c.cast("double").alias(names[t]) for t, c in terms.items()])
    halo = with_halo(rows, slot, lags, size)
    w = Window.partitionBy(chunk_key(by)).orderBy(slot)
    copies = {f"{names[t]}_{k}": F.lag(names[t], k).over(w) for t in terms for k in range(1, lags + 1)}
    columns = {f"{t}.{k}": F.col(names[t] if k == 0 else f"{names[t]}_{k}") for k in range(lags + 1) for t in terms}
    return halo.withColumns(copies).where("_home"), columns


def _difference(d: int) -> np.ndarray:
    out = np.ones(1)
    for _ in range(d):
        out = np.convolve(out, [1.0, -1.0])
    return out


def arma_orders(
    df: DataFrame, by: list[str], slot: str, value: str, p: int = 3, d: int = 1, q: int = 2, long: int = 6, size: int = CHUNK
) -> DataFrame:
    """Every model of orders up to (``p``, ``d``, ``q``) for each series, best AICc first, after Hannan and Rissanen.

    A long autoregression (``long`` lags) of the series differenced d times gives its shocks; regressing the series on its own and
    the shocks' lags gives the coefficients. Differences and shocks are sums of lagged values, so all
    regressions follow from one matrix of cross products of d + q + ``long`` lags, summed in one pass over chunks; each series
    is solved from its matrix alone.

    Columns: ``p``, ``d``, ``q``, ``n`` (slots whose lags are all known, the same for all models), ``intercept``, ``ar``, ``ma``,
    ``sigma2``, ``aicc``, ``model_rank``. Errors are those of one step ahead on the same slots, so differenced and plain models
    compare. Models with more parameters than slots allow have no AICc and rank last.
    """
    reach = d + q + long
    rows, columns = lagged(df, by, slot, {"y": F.col(value)}, reach, size)
    grams = gram(rows, by, columns)

    def solve(n: np.ndarray, m: np.ndarray, c: np.ndarray):
        for order in range(d + 1):
            step = _difference(order)
            # Rows of ``shift``: the differenced series now and 1 to q + long slots ago, as sums of lagged values.
            shift = np.zeros((q + long + 1, reach + 1))
            for k in range(len(shift)):
                shift[k, k : k + len(step)] = step
            u, mean = shift @ c @ shift.T, m @ shift.T
            a, _, _ = regress(u, 0, list(range(1, long + 1)))
            # Then the differenced series up to p slots ago and the shocks 1 to q slots ago.
            turn = np.zeros((len(n), 1 + p + q, len(shift)))
            turn[:, range(1 + p), range(1 + p)] = 1.0
            for j in range(1, q + 1):
                turn[:, p + j, j] = 1.0
                turn[:, p + j, j + 1 : j + 1 + long] = -a
            both = turn @ u @ turn.transpose(0, 2, 1)
            # The mean of a shock is not 0 over these slots: the long regression's constant is taken off.
            level = mean[:, 0] - (a * mean[:, 1 : long + 1]).sum(axis=1)
            means = (turn @ mean[:, :, None])[:, :, 0]
            means[:, p + 1 :] -= level[:, None]
            for i in range(p + 1):
                for j in range(q + 1):
                    xs = [*range(1, i + 1), *range(p + 1, p + 1 + j)]
                    b, rss, used = regress(both, 0, xs)
                    constant = means[:, 0] - (b * means[:, xs]).sum(axis=1)
                    aicc = information(n, rss, used.sum(axis=1) + 2.0)
                    whole = [np.full(len(n), v) for v in (i, order, j)]
                    yield [*whole, n.astype(np.int64), constant, list(b[:, :i]), list(b[:, i:]), rss / n, [None if np.isnan(v) else v for v in aicc]]

    names = [("p", LONG), ("d", LONG), ("q", LONG), ("n", LONG), ("intercept", DOUBLE), ("ar", DOUBLES), ("ma", DOUBLES), ("sigma2", DOUBLE), ("aicc", DOUBLE)]
    out = each_group(grams, by, StructType([field(*f) for f in names]), solve)
    return ranked(out, by, ["p", "d", "q"])


def ranked(models: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """Add ``model_rank``: the place under AICc within the group, whose rows are the models compared."""
    order = Window.partitionBy(*by).orderBy(F.col("aicc").asc_nulls_last(), *ties)
    return models.withColumn("model_rank", F.row_number().over(order))


def compare_models(
    df: DataFrame,
    by: list[str],
    slot: str,
    y: str,
    terms: dict[str, Column],
    models: dict[str, list[str]],
    steps: int = 30,
    size: int = CHUNK,
) -> DataFrame:
    """Models of ``y`` on several terms, each with independent and with autocorrelated errors, best AICc first.

    ``terms`` names the predictors (products of columns are interactions), ``models`` lists the terms of each model.
    One matrix of all terms and their values one slot before, summed in one pass, holds every model: without the lag by
    sweeping the model's terms, with errors of first order by the same on ``x(t) - rho x(t-1)``, whose cross products are sums of
    the matrix' own. ``rho`` is the residuals' regression on their predecessors, repeated up to ``steps`` times until it
    stays (the estimate of Cochrane and Orcutt). All models see the slots that have all terms and predecessors.

    Columns: ``model``, ``errors`` (``iid`` or ``ar1``), ``n``, ``n_par`` (the variance among them), ``rho``, ``intercept``,
    ``estimates`` (in the order of the model's terms), ``mean_rss``, ``aicc``, ``model_rank``. A term that follows from others has
    no parameter and the estimate 0.
    """
    names = [y, *terms]
    rows, columns = lagged(df, by, slot, {y: F.col(y)} | terms, 1, size)
    grams = gram(rows, by, columns)
    width = len(names)

    def solve(n: np.ndarray, m: np.ndarray, c: np.ndarray):
        # Terms now stand before the terms of the slot before, so each block of the matrix is one lag.
        now, cross, past = c[:, :width, :width], c[:, :width, width:], c[:, width:, width:]

        def without(rho: np.ndarray) -> np.ndarray:
            r = rho[:, None, None]
            return now - r * (cross + cross.transpose(0, 2, 1)) + r * r * past

        def fitted(rho: np.ndarray, xs: list[int]):
            b, rss, used = regress(without(rho), 0, xs)
            left = np.zeros((len(n), width))
            left[:, 0] = 1.0
            left[:, xs] = -b
            along = np.einsum("bi,bij,bj->b", left, cross, left)
            before = np.einsum("bi,bij,bj->b", left, past, left)
            return b, rss, used, np.where(before > 0, along / np.where(before > 0, before, 1.0), 0.0)

        for name, chosen in models.items():
            xs = [names.index(t) for t in chosen]
            rho = np.zeros(len(n))
            for errors in ("iid", "ar1"):
                b, rss, used, after = fitted(rho, xs)
                if errors == "ar1":
                    for _ in range(steps):
                        stays = np.abs(after - rho) <= 1e-12
                        rho = np.where(stays, rho, after)
                        b, rss, used, after = fitted(rho, xs)
                        if stays.all():
                            break
                k = used.sum(axis=1) + (2.0 if errors == "iid" else 3.0)
                off = m[:, :width] - rho[:, None] * m[:, width:]
                share = np.where(rho == 1, 1.0, 1 - rho)
                level = (off[:, 0] - (b * off[:, xs]).sum(axis=1)) / share
                aicc = [None if np.isnan(v) else v for v in information(n, rss, k)]
                label = [[text] * len(n) for text in (name, errors)]
                yield [*label, n.astype(np.int64), k.astype(np.int64), rho if errors == "ar1" else [None] * len(n), level, list(b), rss / n, aicc]

    fields = [("model", TEXT), ("errors", TEXT), ("n", LONG), ("n_par", LONG), ("rho", DOUBLE), ("intercept", DOUBLE), ("estimates", DOUBLES), ("mean_rss", DOUBLE), ("aicc", DOUBLE)]
    out = each_group(grams, by, StructType([field(*f) for f in fields]), solve)
    return ranked(out, by, ["model", "errors"])
