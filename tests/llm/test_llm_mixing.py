"""Mixing against a plain computation, and its promises."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from seriesframe.llm import mixing


def brute(rows, weights=(3.0, 1.0, 2.0)):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) if t else 0
    docs = [(i, s, size(t)) for i, t, s in rows]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = Counter()
    for _, s, n in docs:
        total[s] += n
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    capped, level = {s for s in sources if not total[s]}, 0.0
    while True:
        free = [s for s in sources if s not in capped]
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in free) if free else level
        over = {s for s in free if 2 * total[s] < level * weight[s]}
        if not over:
            break
        capped |= over
    target = {s: min(2.0 * total[s], level * weight[s]) for s in sources}
    turn = lambda i: hashlib.md5(f"mix/{'null' if i is None else i}".encode()).hexdigest()[:16]
    out, start = [], Counter()
    for i, s, n in sorted(docs, key=lambda d: (turn(d[0]), d[0] is not None, d[0] or 0, d[2])):
        taken = sum(max(0, min(n, math.floor(target[s]) - start[s] - k * total[s])) for k in (0, 1))
        out.append((i, n, total[s], round(target[s], 6), taken))
        start[s] += n
    return sorted(out, key=str)


def test_equal_to_plain_computation(odd_docs, odd_rows, monkeypatch):
    want = brute([(r[0], r[1], r[3]) for r in odd_rows])
    for chunk_rows in (50_000, 2):
        monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk_rows)
        got = mixing.fair_queue(odd_docs).select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_promises(odd_docs):
    rows = mixing.fair_queue(odd_docs).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) < 1 for t, n in by.values())
    assert abs(sum(n for _, n in by.values()) - 1.5 * sum(r.size for r in rows)) < len(by)
    finish = [r.finish for r in rows if r.finish is not None]
    assert finish == sorted(finish)


def test_mixed_rows_are_rows_of_the_table(odd_docs):
    mix = mixing.mixed_documents(odd_docs)
    assert mix.columns == odd_docs.columns
    have, got = Counter(map(tuple, odd_docs.collect())), Counter(map(tuple, mix.collect()))
    assert got and all(n <= 2 * have[r] for r, n in got.items())


def test_empty_and_wordless(spark, no_docs):
    assert mixing.fair_queue(no_docs).collect() == []
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.fair_queue(docs).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(docs).collect() == []


def test_places_in_order(spark):
    frame = spark.range(1_000).selectExpr("id * 7919 % 1000 as v").repartition(5)
    assert all(r.v == r.place for r in mixing.numbered(frame, [F.asc("v")]).collect())
