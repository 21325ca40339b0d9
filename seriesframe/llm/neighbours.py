"""Nearest neighbours by cosine as a block matrix join: int8 tiles with error bounds, floats for what survives."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seriesframe.llm.sharing import received, sent
from seriesframe.sources.files import settle

#: Most rows of a tile on the candidates' side, bytes of query vectors that one broadcast holds, and most cells (queries times
#: candidates) of a tile, a handful of whose matrices a task holds at once.
TILE, QUERY_BYTES, CELLS = 2_048, 16_000_000, 4_000_000


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: cosines stay the same to the last digit, and no
    square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length as int8, with a scale per row and the exact length of what rounding left out."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1) + 1e-12


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Product of the int8 codes and how far the cosine of unit rows can be from it.

    With q = q' + e and c = c' + f, the cosine is q'c' + q'f + ec, so it is off by at most |q'||f| + |e||c|, |c| = 1.
    """
    # float32 holds the integers of an int8 product exactly up to 2^24, so up to 1,000 dimensions; float64 beyond.
    kind = np.float32 if q[0].shape[1] <= 1_000 else np.float64
    near = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64) * q[1][:, None] * c[1][None, :]
    return near, (1 + q[2])[:, None] * c[2][None, :] + q[2][:, None] + 1e-9


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row in double precision, dimensions added in order: equal rows get equal values."""
    dot, own, other = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for k in range(len(q)):
        dot += rows[:, k] * q[k]
        own += rows[:, k] * rows[:, k]
        other += q[k] * q[k]
    return dot / (np.sqrt(own) * np.sqrt(other))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch whose vectors have one length."""
    lists = batch.column(1)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), flat.reshape(batch.num_rows, -1)


def _searcher(shared, k: int) -> Callable:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = received(shared)
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        q = quantised(unit)
        heaps: list[list] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)
        step = max(1, min(TILE, CELLS // max(len(ids), 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                own, rows = _matrix(batch.slice(at, step))
                rows = scaled(rows)
                near, off = bounds(q, quantised(rows / np.sqrt((rows * rows).sum(axis=1))[:, None]))
                low = near - off
                low[ids[:, None] == own[None, :]] = -np.inf
                if len(own) > k:
                    tile_floor = np.partition(low, len(own) - k, axis=1)[:, len(own) - k]
                    floor = np.maximum(floor, tile_floor)
                survivors = near + off >= floor[:, None]
                for i in np.flatnonzero(survivors.any(axis=1)):
                    j = np.flatnonzero(survivors[i] & (own != ids[i]))
                    if not len(j):
                        continue
                    score = cosine(vectors[i], rows[j])
                    order = np.lexsort((own[j], -score))[:k]
                    for s, v in zip(score[order].tolist(), own[j][order].tolist()):
                        entry = (s, -v)
                        if len(heaps[i]) < k:
                            heapq.heappush(heaps[i], entry)
                        elif entry > heaps[i][0]:
                            heapq.heapreplace(heaps[i], entry)
                    if len(heaps[i]) == k:
                        floor[i] = max(floor[i], heaps[i][0][0] - 1e-9)
        found = [(int(q_id), -v, s) for q_id, heap in zip(ids, heaps) for s, v in heap]
        columns = list(zip(*found)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors with an id, without null or non-finite components, and with a length."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    return out.filter(F.col("vec_id").isNotNull() & F.coalesce(fine & some, F.lit(False)))


def nearest(vectors: DataFrame, queries: F.Column | str, k: int = 5) -> DataFrame:
    """For each row for which ``queries`` holds, the ``k`` rows of other ids with the largest cosine.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller ``vec_id``. The result is exact.
    Each task multiplies int8 tiles of its candidates with a block of queries, drops what the error bounds show to be
    under the k-th best, recomputes the rest in double precision and keeps a heap of ``k`` per query; one window
    merges the heaps. Query blocks hold at most QUERY_BYTES, which bounds the broadcast; each block is one pass
    over the candidates. Only vectors of the query's length are compared.

    Null, zero and non-finite vectors and null ids take no part. Rows that repeat an id are compared each, but a row is no
    neighbour of its own id; an id that several queries share gets the nearest of all of them, a candidate once for each. Fewer candidates than ``k`` give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    vectors = usable(vectors).withColumn("d", F.size("embedding"))
    asked = settle(vectors.filter(queries), "queries")
    merged = None
    for d, rows in sorted((r.d, r["count"]) for r in asked.groupBy("d").count().collect()):
        blocks = -(-rows * d * 8 // QUERY_BYTES)
        candidates = vectors.filter(F.col("d") == d).select("vec_id", "embedding")
        for block in range(blocks):
            own = asked.filter((F.col("d") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block))
            own = sorted(map(tuple, own.select("vec_id", "embedding").collect()))
            vectors_of = scaled(np.array([v for _, v in own], np.float64).reshape(len(own), d))
            pack = (np.array([i for i, _ in own], np.int64), vectors_of)
            found = candidates.mapInArrow(
                _searcher(sent(spark, pack), k), "query_id long, vec_id long, score double"
            )
            merged = found if merged is None else merged.unionByName(found)
    if merged is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
