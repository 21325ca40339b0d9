"""Codes of vectors against plain k-means in whole numbers, part by part."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesframe.llm import vector_codes
from seriesframe.llm.queries import op12_vector_codes

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{(vec_id, d): ...} and codebooks, one vector at a time."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out, books = [], {}
    for d in {len(v) for _, v, _ in kept}:
        own = [(i, [math.floor(Fraction(x) * scale) for x in v], g) for i, v, g in kept if len(v) == d]
        at = vector_codes.edges(d, parts)
        codes, errors, books[d] = [""] * len(own), [0] * len(own), []
        for a, b in zip(at, at[1:]):
            x = [v[a:b] for _, v, _ in own]
            book = x[:entries]

            def nearest(p):
                return min((sum((s - t) ** 2 for s, t in zip(p, e)), k) for k, e in enumerate(book))

            for _ in range(rounds):
                owner = [nearest(p)[1] for p in x]
                groups = [[p for p, o in zip(x, owner) if o == k] for k in range(len(book))]
                book = [[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(groups, book)]
            for k, p in enumerate(x):
                error, code = nearest(p)
                codes[k] += f"{code:02x}"
                errors[k] += error
            books[d].append(book)
        out += [(i, g, d, c, min(e, 2**63 - 1)) for (i, _, g), c, e in zip(own, codes, errors)]
    return out, books


def table():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    rows = [(k, (base[k % 20] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist(), k % 5) for k in range(260)]
    rows += [(300 + k, rows[3][1], None) for k in range(60)]  # one vector many times
    rows += [(400 + k, np.round(rng.normal(size=16)).tolist(), 9) for k in range(40)]  # ties
    rows += [(500, None, 1), (501, [math.nan] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [math.inf] + [0.0] * 15, 1)]
    return rows + [(None, [0.5] * 16, 2), (5, rows[7][1], 1), (5, rows[5][1], 0)]


def key(row):
    return tuple((v is None, str(v)) for v in row)


def check(spark, rows, **how):
    frame = spark.createDataFrame(rows, SHAPE).selectExpr("*", "'a' as code", "7 as d", "8 as error", "1 as part").repartition(5)
    coded, books = vector_codes.compress(frame, **how)
    want, want_books = brute(rows, **how)
    assert dict(books) == want_books
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("chunk", "leaf"), [(1 << 19, 24), (1_600, 2), (320, 1)])
def test_equal_to_plain_rounds(spark, monkeypatch, chunk, leaf):
    monkeypatch.setattr(vector_codes, "CHUNK_VALUES", chunk)
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    check(spark, table())


def test_other_parameters_lengths_and_few_rows(spark):
    rows = table() + [(900 + k, [float(k), 1.0, -k / 3], 1) for k in range(20)] + [(950, [], 3), (951, [], 3), (960, [2.0], 1)]
    check(spark, rows, parts=3, entries=5, rounds=2, scale=100)
    check(spark, rows[:3])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * 10.0 ** rng.integers(0, 9)).tolist(), 0) for k in range(80)]
    check(spark, rows + [(100 + k, [1e4 * k, -3e30, 3e38, 7.0, 2.0**40, 0.1, -0.1, 5e9 + k], 1) for k in range(20)])


def test_balls_hold_their_points_and_sums():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(3_000, 8)) * 4096).astype(np.int64)
    x[100:900] = x[3]
    tree = vector_codes.Tree.of(x)
    assert sorted(tree.order.tolist()) == list(range(3_000)) and (tree.points == x[tree.order]).all()
    for k in range(len(tree.low)):
        own = tree.points[tree.low[k] : tree.high[k]]
        assert (own.sum(axis=0) == tree.sums[k]).all()
        assert np.sqrt(((own - tree.centre[k]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-6
        if tree.left[k] >= 0:
            assert tree.low[k] == tree.low[tree.left[k]] and tree.high[tree.left[k]] == tree.low[tree.right[k]]
    clusters = np.repeat(rng.normal(size=(16, 8)) * 40_000, 200, axis=0)
    near = np.floor(clusters + rng.normal(size=clusters.shape) * 50).astype(np.int64)
    balls, _, points, _ = vector_codes.Tree.of(near).owners(near[::200])
    assert len(points) == 0 and len(balls) < 200  # clear clusters are owned as balls, no point is looked at


def test_limbs():
    for v in (0, -1, 5, 2**60, -(2**60), 2**59 - 1, -(2**200) + 17, 3**150):
        assert sum(x << (vector_codes.LIMB * k) for k, x in enumerate(vector_codes.limbs(v))) == v
        assert all(-(2**63) <= x < 2**63 for x in vector_codes.limbs(v))


def test_empty_table(spark):
    frame = spark.createDataFrame([], SHAPE)
    coded, books = vector_codes.compress(frame)
    assert coded.collect() == [] and not books


def test_query_sums_labels(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op12_vector_codes(spark, str(tmp_path)).collect()
    want, books = brute(rows)
    totals = {g: sum(r[4] for r in want if r[1] == g) for g in {r[1] for r in want}}
    digest = vector_codes.Codebooks(books).digest(16)
    expected = [(i, c, e, totals[g], digest) for i, g, _, c, e in want]
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op12_vector_codes(spark, f"{tmp_path}/none").collect() == []
