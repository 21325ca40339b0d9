"""The language model: base scores and counts against plain ones, recursions against enumeration, gain on held-out texts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np

from seriesframe.llm import language_model as lm
from seriesframe.llm.words import words_of


def brute(rows):
    held = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 10 == 0
    tokens = [(i, [*words_of(t.encode() if t is not None else None), lm.END]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return sorted(
        ((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(map(base, ws)), 5)) for i, ws in tokens), key=str
    )


def test_counts_and_base_scores(odd_docs, odd_rows, monkeypatch):
    want = brute([(r[0], r[1]) for r in odd_rows])
    for own in (lm.OWN, 20):
        monkeypatch.setattr(lm, "OWN", own)
        rows = lm.scores(odd_docs).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows), key=str)
        assert got == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_held_out_texts_become_likelier(spark):
    """Two kinds of texts with words of their own: states tell them apart, single word counts do not."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"{'ab'[k % 2]}{rng.integers(0, 40)}" for _ in range(60))) for k in range(300)]
    out = [r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(out) > 10 and all(r.score > r.base_score + 5 for r in out)


def test_empty_and_untrained(spark, no_docs):
    assert lm.scores(no_docs).collect() == []
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    rows = lm.scores(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def small_chain(classes=6):
    rng = np.random.default_rng(2)
    draw = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    return lm.Chain(draw(lm.STATES), draw(lm.STATES), draw(lm.STATES, lm.STATES), draw(lm.STATES, classes))


def test_forward_recursion_equals_enumeration():
    chain = small_chain()
    sequences = [np.array(s) for s in ([3], [0, 5, 2], [1, 1], [4, 0, 2, 2])]
    for s, got in zip(sequences, lm.log_likelihoods(chain, sequences)):
        total = 0.0
        for path in itertools.product(range(lm.STATES), repeat=len(s)):
            p = chain.first[path[0]] * chain.emits[path[0], s[0]]
            for a, b, w in zip(path, path[1:], s[1:]):
                p *= chain.moves[a, b] * chain.emits[b, w]
            total += p
        assert abs(math.log10(total) - got) < 1e-9


def test_expected_counts_equal_enumeration_and_raise_the_likelihood():
    chain, s = small_chain(), np.array([2, 0, 5, 1])
    counts = lm.Expected(6)
    counts.add(chain, [s], np.array([True]))
    emits, moves, total = np.zeros((lm.STATES, 6)), np.zeros((lm.STATES, lm.STATES)), 0.0
    for path in itertools.product(range(lm.STATES), repeat=len(s)):
        p = chain.first[path[0]] * np.prod([chain.emits[a, w] for a, w in zip(path, s)]) * np.prod([chain.moves[a, b] for a, b in zip(path, path[1:])])
        total += p
        for a, w in zip(path, s):
            emits[a, w] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    assert np.allclose(counts.emits, emits / total, atol=1e-4) and np.allclose(counts.moves, moves / total, atol=1e-4)


def test_classes_add_up_to_one():
    u = lm.Unigrams({}, np.full(lm.OWN, 3.0), np.full(lm.SHAPES, 7.0), np.full(lm.SHAPES, 5.0), 3 * lm.OWN + 7 * lm.SHAPES, lm.OWN + 5 * lm.SHAPES)
    assert abs((10**u.logs).sum() - 1) < 0.01
    assert all(0 <= lm.shape(w) < lm.SHAPES for w in (b"a", b"", b"caf\xc3\xa9!", b"x" * 1000, b"12,5"))
