"""Near duplicates against brute force, and components against a walk over the edges."""

import random

import numpy as np
import pytest

from seriesframe.llm import near_dup
from seriesframe.llm.components import components
from seriesframe.llm.words import words_of


def brute(rows, size, share=80):
    """component and set size by comparing all pairs of rows that have an id."""
    sets, parent = [], {}
    for doc_id, text in rows:
        words = words_of(text.encode() if text is not None else None)
        n = min(size, len(words))
        sets.append((doc_id, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()))
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= share * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted(((a, len(x), root(a), root(a) == a) if a is not None else (a, len(x), None, True) for a, x in sets), key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_odd_rows_equal_brute_force(odd_docs, odd_rows, size):
    got = near_dup.near_duplicates(odd_docs, size=size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r[0], r[1]) for r in odd_rows], size)


def test_variants_that_link_only_through_others(spark, monkeypatch):
    """A group whose members mostly differ too much from each other, in tiles of a few texts."""
    monkeypatch.setattr(near_dup, "TILE_TEXTS", 7)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(0, 5)):
            words[at] = f"v{rng.randint(0, 10**9)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(docs, size=4).collect()), key=str) == brute(rows, 4)


def test_empty_table(no_docs):
    assert near_dup.near_duplicates(no_docs).collect() == []


def test_overlaps_of_a_tile():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 30, 60, 0)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = near_dup.overlaps(sets)
    assert [[got[i, j] if i != j else len(sets[i]) for j in range(5)] for i in range(5)] == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (50, 60), (60, 50), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 10 for k in range(10, 41)}, **{k: 100 for k in range(100, 130)}, 50: 50, 60: 50}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_minima_agree_as_often_as_sets_are_alike():
    a, b = near_dup._hashers()
    rng = np.random.default_rng(1)
    items = np.unique(rng.integers(0, 2**63, 2_000).astype(np.uint64))
    x, y = items[:1_800], items[200:]
    alike = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((near_dup.minima(x, a, b) == near_dup.minima(y, a, b)).mean() - alike) < 0.12
