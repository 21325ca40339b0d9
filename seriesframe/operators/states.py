"""Random walks under noise: filtering and smoothing of series of any length by steps that can be put together."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from seriesframe.operators.relate import attach, join_keep_left
from seriesframe.operators.scan import CHUNK, chunk_key, slot_chunk
from seriesframe.sources.files import settle

#: Variance of the state before a series begins, as a multiple of the noise: nothing is known about it.
DIFFUSE = 1e7
DOUBLES = ArrayType(DoubleType())


@dataclass(frozen=True)
class Walk:
    """A level that walks (``level``), or one with a slope that walks, too (``trend``), seen through noise of variance 1.

    ``ratios`` holds the variances of the walks' steps as multiples of the noise; all of them are worked on at once.
    """

    kind: str
    ratios: tuple[tuple[float, ...], ...]

    @property
    def size(self) -> int:
        return 1 if self.kind == "level" else 2

    @property
    def move(self) -> np.ndarray:
        return np.eye(1) if self.kind == "level" else np.array([[1.0, 1.0], [0.0, 1.0]])

    @property
    def spread(self) -> np.ndarray:
        return np.array([np.diag(q) for q in self.ratios], np.float64)

    def only(self, place: int) -> Walk:
        return Walk(self.kind, (self.ratios[place],))


def usual_ratios(kind: str) -> tuple[tuple[float, ...], ...]:
    """25 ratios from 1e-4 to 100 for a level; for a trend 9 of them with slopes that walk by 0 to a tenth of the level's step."""
    if kind == "level":
        return tuple((float(q),) for q in np.logspace(-4, 2, 25))
    return tuple(product(np.logspace(-4, 2, 9).tolist(), (0.0, 1e-6, 1e-4, 1e-2, 1e-1)))


def _turned(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def _inverse(a: np.ndarray) -> np.ndarray:
    if a.shape[-1] == 1:
        return 1.0 / a
    p, q, r, s = a[..., 0, 0], a[..., 0, 1], a[..., 1, 0], a[..., 1, 1]
    out = np.empty_like(a)
    out[..., 0, 0], out[..., 0, 1], out[..., 1, 0], out[..., 1, 1] = s, -q, -r, p
    return out / (p * s - q * r)[..., None, None]


def step(walk: Walk, seen: bool) -> tuple:
    """One slot as an element (a, b, c, h, j), b and h for an observation of 1.

    Given the state x before it, the state after it has mean a x + b and variance c; h and j say what the slot's observation
    tells about x, as information.
    """
    f, q, size = walk.move, walk.spread, walk.size
    if not seen:
        zero = np.zeros((len(q), size, 1))
        return np.broadcast_to(f, q.shape).copy(), zero, q, zero, np.zeros_like(q)
    s = (q[:, 0, 0] + 1.0)[:, None, None]
    gain = q[:, :, :1] / s
    keep = np.eye(size) - gain @ np.eye(1, size)[None]
    back = f[0][None, :, None] / s
    return keep @ f, gain, keep @ q, back, back @ (f[0][None, None, :])


def together(first: tuple, then: tuple) -> tuple:
    """Two neighbouring elements as one; the grouping does not matter."""
    a, b, c, h, j = first
    a2, b2, c2, h2, j2 = then
    eye = np.eye(a.shape[-1])
    m, n = _inverse(eye + c @ j2), _inverse(eye + j2 @ c)
    am, an = a2 @ m, _turned(a) @ n
    return am @ a, am @ (b + c @ h2) + b2, am @ c @ _turned(a2) + c2, an @ (h2 - j2 @ b) + h, an @ j2 @ a + j


def element(walk: Walk, y: np.ndarray) -> tuple:
    """All slots of a chunk as one element."""
    seen, unseen = step(walk, True), step(walk, False)
    out = None
    for v in y.tolist():
        now = unseen if v != v else (seen[0], seen[1] * v, seen[2], seen[3] * v, seen[4])
        out = now if out is None else together(out, now)
    return out


def filtered(walk: Walk, y: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple:
    """States after each slot, sums of the logarithms of the forecasts' variances and of the weighted squared errors."""
    f, q = walk.move, walk.spread
    means, spreads = np.empty((len(y), *m.shape)), np.empty((len(y), *p.shape))
    logs, errors = np.zeros(len(q)), np.zeros(len(q))
    for k, v in enumerate(y.tolist()):
        m, p = f @ m, f @ p @ f.T + q
        if v == v:
            s = p[:, 0, 0] + 1.0
            off = v - m[:, 0, 0]
            gain = p[:, :, :1] / s[:, None, None]
            m, p = m + gain * off[:, None, None], p - gain @ p[:, :1, :]
            logs, errors = logs + np.log(s), errors + off * off / s
        means[k], spreads[k] = m, p
    return means, spreads, logs, errors


def back_maps(walk: Walk, means: np.ndarray, spreads: np.ndarray) -> tuple:
    """Per slot (e, g, l): from the smoothed state x, P of the next slot to e x + g and e P e' + l. For one ratio."""
    f, q = walk.move, walk.spread[0]
    e = spreads @ f.T @ _inverse(f @ spreads @ f.T + q)
    return e, means - e @ f @ means, spreads - e @ f @ spreads


def _flat(*arrays: np.ndarray) -> list[float]:
    return np.concatenate([np.ravel(a) for a in arrays]).tolist()


def _unflat(values, *shapes) -> list[np.ndarray]:
    out, at, values = [], 0, np.asarray(values, np.float64)
    for shape in shapes:
        n = int(np.prod(shape))
        out.append(values[at : at + n].reshape(shape))
        at += n
    return out


def _in_order(table: pa.Table, column: str) -> pa.Table:
    return table.sort_by(column)


def smooth_states(
    df: DataFrame,
    by: list[str],
    slot: str,
    value: str,
    kind: str = "level",
    ratios: tuple[tuple[float, ...], ...] | None = None,
    size: int = CHUNK,
) -> DataFrame:
    """Add ``level`` (and ``slope`` for a trend), ``level_var``, ``ratio`` (its place in ``ratios``) and ``sigma2``.

    The state of each slot given all values of the series before and after it: the smoothed random walk (``level``) or random walk
    with a walking slope (``trend``). ``ratios`` lists the variances of the walks' steps as multiples of the
    noise's; the most likely entry counts for each series, the first one of equals, and the noise follows
    from it. ``df`` has one row per slot, missing values among them, which is where smoothing fills.

    A series is cut into chunks. A chunk's slots are put together into one element; the elements of a series, one row a chunk,
    give the state before each chunk; with it the chunks are filtered on their own. The way back is the same: a
    chunk's backward steps are one map, the maps give the state behind each chunk. All of it equals the sequential filter.
    A series without any value stays without states.
    """
    walk = Walk(kind, tuple(tuple(map(float, q)) for q in ratios or usual_ratios(kind)))
    many, d = len(walk.ratios), walk.size
    shapes = [(many, d, d), (many, d, 1), (many, d, d), (many, d, 1), (many, d, d)]
    keyed = df.withColumns({"_chunk": slot_chunk(slot, size), "_value": F.col(value).cast("double")}).withColumn("_key", chunk_key(by))
    fields = [df.schema[b] for b in by]
    rows = keyed.select(*by, "_key", slot, "_value")
    per_chunk = [*fields, StructField("_chunk", LongType())]

    def values(table: pa.Table) -> np.ndarray:
        return _in_order(table, slot)["_value"].to_numpy()

    def head(table: pa.Table) -> list[pa.Array]:
        """Series and chunk of a chunk's rows."""
        return [*[table[b].chunk(0)[:1] for b in by], pa.array([table["_key"][0].as_py()["_chunk"]], pa.int64())]

    def one_row(table: pa.Table, names: list[str], columns: list) -> pa.Table:
        arrays = [*head(table.combine_chunks()), *columns]
        return pa.Table.from_arrays(arrays, names=[*by, "_chunk", *names])

    doubles = pa.list_(pa.float64())

    def put_together(table: pa.Table) -> pa.Table:
        y = values(table)
        known = y[~np.isnan(y)]
        columns = [pa.array([len(known)], pa.int64()), pa.array([known.sum()]), pa.array([_flat(*element(walk, y))], doubles)]
        return one_row(table, ["n", "total", "element"], columns)

    shape = StructType([*per_chunk, StructField("n", LongType()), StructField("total", DoubleType()), StructField("element", DOUBLES)])
    elements = settle(rows.groupBy("_key").applyInArrow(put_together, shape), "elements")

    def run_forward(table: pa.Table) -> pa.Table:
        """State before each chunk: one row a chunk, a few numbers each."""
        table = _in_order(table, "_chunk")
        n = sum(table["n"].to_pylist())
        m, p = np.zeros((many, d, 1)), np.broadcast_to(np.eye(d) * DIFFUSE, (many, d, d))
        m[:, 0, 0] = sum(table["total"].to_pylist()) / n if n else np.nan
        starts, none = [], (np.zeros((many, d, d)), m, p, np.zeros((many, d, 1)), np.zeros((many, d, d)))
        for e in table["element"]:
            starts.append(_flat(none[1], none[2]))
            none = together(none, tuple(_unflat(e.values, *shapes)))
        keys = [table[c] for c in [*by, "_chunk"]]
        return pa.Table.from_arrays([*keys, pa.array(starts, doubles)], names=[*by, "_chunk", "start"])

    series = F.struct(*by) if by else F.lit(0)
    forward = elements.withColumn("_series", series).groupBy("_series")
    forward = forward.applyInArrow(run_forward, StructType([*per_chunk, StructField("start", DOUBLES)]))
    starts = settle(forward, "starts").withColumn("_key", chunk_key(by))

    def started(start: pa.Table) -> list[np.ndarray]:
        return _unflat(start["start"].combine_chunks().values, (many, d, 1), (many, d, d))

    def likely(table: pa.Table, start: pa.Table) -> pa.Table:
        y = values(table)
        _, _, logs, errors = filtered(walk, y, *started(start))
        n = np.full(many, float(np.count_nonzero(~np.isnan(y))))
        return one_row(table, ["sums"], [pa.array([_flat(n, logs, errors)], doubles)])

    sums = rows.groupBy("_key").cogroup(starts.groupBy("_key")).applyInArrow(likely, StructType([*per_chunk, StructField("sums", DOUBLES)]))
    sums = sums.select(*by, F.posexplode("sums").alias("place", "v")).groupBy(*by, "place").agg(F.sum("v").alias("v"))
    sums = sums.select(*by, (F.col("place") % many).alias("ratio"), F.floor(F.col("place") / many).alias("what"), "v")
    pick = lambda k: F.max(F.when(F.col("what") == k, F.col("v")))
    fits = sums.groupBy(*by, "ratio").agg(pick(0).alias("n"), pick(1).alias("logs"), pick(2).alias("errors"))
    noise = F.when(F.col("n") > 0, F.col("errors") / F.col("n"))
    # Minus twice the logarithm of the likelihood, but for terms that all ratios share.
    cost = F.col("n") * F.log(F.greatest(noise, F.lit(2.2250738585072014e-308))) + F.col("logs")
    best = fits.select(*by, F.struct(cost.alias("cost"), "ratio", noise.alias("sigma2")).alias("fit"))
    best = settle(best.groupBy(*by).agg(F.min("fit").alias("fit")).select(*by, "fit.ratio", "fit.sigma2"), "ratios")

    chosen = attach(starts.drop("_key"), best.select(*by, "ratio"), by).withColumn("_key", chunk_key(by))

    def states(table: pa.Table, start: pa.Table) -> tuple[Walk, np.ndarray, np.ndarray, np.ndarray]:
        place = start["ratio"][0].as_py()
        m, p = (a[place : place + 1] for a in started(start))
        means, spreads, _, _ = filtered(walk.only(place), values(table), m, p)
        return walk.only(place), means[:, 0], spreads[:, 0]

    def put_back(table: pa.Table, start: pa.Table) -> pa.Table:
        """One map from the chunk's last slot to its first, the map from behind its last slot, and that slot's own state."""
        own, means, spreads = states(table, start)
        maps = back_maps(own, means, spreads)
        e, g, l = np.eye(d), np.zeros((d, 1)), np.zeros((d, d))
        for e1, g1, l1 in zip(*(x[-2::-1] for x in maps)):
            e, g, l = e1 @ e, e1 @ g + g1, e1 @ l @ e1.T + l1
        return one_row(table, ["back"], [pa.array([_flat(e, g, l, *(x[-1] for x in maps), means[-1], spreads[-1])], doubles)])

    backward = rows.groupBy("_key").cogroup(chosen.groupBy("_key"))
    maps = settle(backward.applyInArrow(put_back, StructType([*per_chunk, StructField("back", DOUBLES)])), "maps")

    def run_backward(table: pa.Table) -> pa.Table:
        """Smoothed state of each chunk's last slot, from the last chunk to the first."""
        table = _in_order(table, "_chunk")
        lasts, first = [], None
        for row in reversed(table["back"].to_pylist()):
            e, g, l, e1, g1, l1, m, p = _unflat(row, *[(d, d), (d, 1), (d, d)] * 2, (d, 1), (d, d))
            last = (m, p) if first is None else (e1 @ first[0] + g1, e1 @ first[1] @ e1.T + l1)
            lasts.append(_flat(*last))
            first = e @ last[0] + g, e @ last[1] @ e.T + l
        keys = [table[c] for c in [*by, "_chunk"]]
        return pa.Table.from_arrays([*keys, pa.array(lasts[::-1], doubles)], names=[*by, "_chunk", "last"])

    lasts = maps.withColumn("_series", series).groupBy("_series")
    lasts = lasts.applyInArrow(run_backward, StructType([*per_chunk, StructField("last", DOUBLES)]))
    both = settle(join_keep_left(chosen.drop("_key"), lasts, [*by, "_chunk"], "inner", null_safe=True), "states")
    names = ["level", "slope"][:d]
    shape = StructType([*fields, df.schema[slot], *[StructField(n, DoubleType()) for n in [*names, "level_var"]]])

    def put_forward(table: pa.Table, start: pa.Table) -> pa.Table:
        own, means, spreads = states(table, start)
        e, g, l = back_maps(own, means, spreads)
        state = _unflat(start["last"].combine_chunks().values, (d, 1), (d, d))
        means[-1], spreads[-1] = state
        for k in range(len(means) - 2, -1, -1):
            state = e[k] @ state[0] + g[k], e[k] @ state[1] @ e[k].T + l[k]
            means[k], spreads[k] = state
        known = lambda x: pa.array(x, pa.float64(), from_pandas=True)
        columns = [known(means[:, k, 0]) for k in range(d)] + [known(spreads[:, 0, 0])]
        ordered = _in_order(table, slot)
        return pa.Table.from_arrays([*[ordered[c] for c in [*by, slot]], *columns], names=shape.names)

    done = rows.groupBy("_key").cogroup(both.withColumn("_key", chunk_key(by)).groupBy("_key")).applyInArrow(put_forward, shape)
    done = attach(done, best, by).withColumn("level_var", F.when(F.col("level").isNotNull(), F.col("level_var") * F.col("sigma2")))
    return join_keep_left(df, done, [*by, slot], "left", null_safe=True)


def impute_states(df: DataFrame, by: list[str], slot: str, value: str, name: str = "filled", kind: str = "level", **how) -> DataFrame:
    """Missing values become the smoothed level of their slot."""
    out = smooth_states(df, by, slot, value, kind, **how)
    return out.select(*df.columns, F.coalesce(F.col(value), F.col("level")).alias(name))
