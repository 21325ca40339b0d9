"""Normal equations: one matrix of sums per group, and every model solved from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: A pivot under this part of its term's own spread means that the term follows from the others.
ALIASED = 1e-10


def gram(df: DataFrame, by: list[str], terms: dict[str, Column]) -> DataFrame:
    """Per group: rows ``_n``, means ``_m`` and centred cross products ``_c`` of the terms (upper triangle, row by row).

    Rows that lack any term are left out, so all models solved from the matrix see the same rows. One partial aggregate;
    covariances are merged around the mean, so large levels cost no digits.
    """
    names = [f"_t{k}" for k in range(len(terms))]
    rows = df.select(*by, *[c.cast("double").alias(n) for n, c in zip(names, terms.values())]).dropna(subset=names)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    n = F.count(F.lit(1))
    cross = [(F.var_pop(a) if a == b else F.covar_pop(a, b)) * n for a, b in pairs]
    return rows.groupBy(*by).agg(n.alias("_n"), F.array(*[F.avg(c) for c in names]).alias("_m"), F.array(*cross).alias("_c"))


def lists(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def squared(upper: np.ndarray, size: int) -> np.ndarray:
    """Full matrices from upper triangles."""
    full = np.zeros((len(upper), size, size))
    i, j = np.triu_indices(size)
    full[:, i, j] = full[:, j, i] = upper
    return full


def sweep(a: np.ndarray, pivots: list[int]) -> np.ndarray:
    """Gauss-Jordan exchange of the pivots in every matrix of ``a``; which terms were exchanged (the others are aliased).

    Afterwards column ``y`` holds the coefficients in the pivots' rows and the residual sum of squares in its own, and the
    pivots' block the inverse of their cross products.
    """
    own = np.einsum("bii->bi", a).copy()
    used = np.zeros(own.shape, bool)
    for k in pivots:
        d = a[:, k, k].copy()
        fine = d > ALIASED * np.maximum(own[:, k], 1e-300)
        p = np.where(fine, 1.0 / np.where(fine, d, 1.0), 0.0)
        column, row = a[:, :, k].copy(), a[:, k, :].copy()
        a -= np.where(fine, p, 0.0)[:, None, None] * column[:, :, None] * row[:, None, :]
        a[:, k, :] = np.where(fine[:, None], row * p[:, None], row)
        a[:, :, k] = np.where(fine[:, None], -column * p[:, None], column)
        a[:, k, k] = np.where(fine, p, d)
        used[:, k] = fine
    return used


def regress(c: np.ndarray, y: int, xs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (0 where aliased), residual sums of squares and which terms count, for a stack of centred matrices."""
    own = c[:, [*xs, y]][:, :, [*xs, y]].copy()
    used = sweep(own, list(range(len(xs))))[:, : len(xs)]
    return np.where(used, own[:, :-1, -1], 0.0), np.maximum(own[:, -1, -1], 0.0), used


def information(n: np.ndarray, rss: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Gaussian AICc with ``k`` estimated parameters, the variance among them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        value = n * (np.log(2 * np.pi) + np.log(rss / n) + 1) + 2 * k + 2.0 * k * (k + 1) / (n - k - 1)
    return np.where((n - k - 1 > 0) & (rss > 0), value, np.nan)


def each_group(grams: DataFrame, by: list[str], added: StructType, solve) -> DataFrame:
    """Rows made from each group's matrix: ``solve(n, m, c)`` gets stacks and returns, per model, a column for each added field."""
    shape = StructType([*[grams.schema[b] for b in by], *added.fields])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            n = np.asarray(batch.column(at("_n")), np.float64)
            m = batch.column(at("_m"))
            width = len(m[0])
            c = squared(lists(batch.column(at("_c")), width * (width + 1) // 2), width)
            keys = [batch.column(at(b)) for b in by]
            for columns in solve(n, lists(m, width), c):
                arrays = [pa.array(v, t) for v, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*keys, *arrays], names=shape.names)

    kinds = {LongType(): pa.int64(), DoubleType(): pa.float64(), StringType(): pa.string(), ArrayType(DoubleType()): pa.list_(pa.float64())}
    types = [kinds[f.dataType] for f in added.fields]
    return grams.select(*by, "_n", "_m", "_c").mapInArrow(work, shape)


def field(name: str, kind) -> StructField:
    return StructField(name, kind)


LONG, DOUBLE, TEXT, DOUBLES = LongType(), DoubleType(), StringType(), ArrayType(DoubleType())
