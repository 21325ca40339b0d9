"""Neighbours against all pairs."""

import numpy as np

from seriesframe.llm import neighbours


def brute(rows, asked, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v]
    fine = [(i, v) for i, v in fine if np.isfinite(v).all() and v.any()]
    out = []
    for i, q in fine:
        if asked(i):
            near = sorted((-neighbours.cosine(q, v[None])[0], j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(near)]
    return sorted(out)


def table():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(25, 16))
    rows = [(k, (base[k % 25] + 0.01 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[3][1]) for k in range(40)]  # equal vectors: ties
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] + [1.0] * 15), (404, [float("inf")] + [0.0] * 15)]
    rows += [(None, rows[0][1]), (405, []), (410, [1.0, 2.0]), (411, [2.0, 1.0]), (5, rows[5][1])]
    return rows


def test_equal_to_all_pairs(spark):
    rows = table()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as d", "2 as score").repartition(3)
    got = sorted(map(tuple, neighbours.nearest(frame, "vec_id % 10 = 0", 5).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_many_query_blocks_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 1_000)
    monkeypatch.setattr(neighbours, "TILE", 7)
    rows = table()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(frame, "vec_id % 50 = 0", 3).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0, 3)


def test_empty_and_single(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(frame, "vec_id % 50 = 0").collect() == []
    assert neighbours.nearest(frame.limit(0), "vec_id % 50 = 0").collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(50, 33)), rng.normal(size=(70, 33)) ** 5))
    near, off = neighbours.bounds(neighbours.quantised(x), neighbours.quantised(y))
    assert (np.abs(x @ y.T - near) <= off).all() and off.max() < 0.1


def test_vectors_of_any_size(spark):
    """Squares of such components leave the range of doubles; their cosines do not."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 8))
    size = [1e200, 1e-200, 1.0, 1e-310, 1e307]
    rows = [(k, (v * size[k % 5]).tolist()) for k, v in enumerate(base)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0", 3).collect()
    plain = [(k, (np.ldexp(np.array(v), -int(np.frexp(np.abs(v).max())[1]))).tolist()) for k, v in rows]
    assert sorted(map(tuple, got)) == brute(plain, lambda i: i % 10 == 0, 3)


def test_cells_of_a_tile_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELLS", 50)
    rows = table()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(frame, "vec_id % 10 = 0", 5).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, 5)
