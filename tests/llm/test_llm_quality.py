"""The classifier on documents whose quality is known."""

import random
import zlib

import numpy as np

from invented import prose
from seriesframe.llm import quality
from seriesframe.llm.words import WordHash


def labelled(n, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        text, good = prose(rng, rng.randint(20, 150)), int(rng.random() < 0.7)
        if not good:
            bad = rng.randint(0, 2)
            text = [" ".join(w + "###" for w in text.split()), text.upper() + "!!", " ".join(["spam"] * len(text.split()))][bad]
        docs.append((k, text))
        labels.append((k, good, 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(600)
    out = quality.quality_scores(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    truth = {k: q for k, q, _ in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert len(out) == 600 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled(200)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q, t) for k, q, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (
        {r.doc_id: r.score for r in quality.quality_scores(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
        for x in (labels, flipped)
    )
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(odd_docs, none).collect()
    assert len(out) == odd_docs.count() and all(0.49 <= r.score <= 0.51 for r in out)
    some = spark.createDataFrame([(k, int(k < 30), 0) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    out = quality.quality_scores(odd_docs, some).collect()
    assert len(out) == odd_docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert quality.quality_scores(no_docs, some).collect() == []
    assert quality.good_documents(odd_docs, some).columns == odd_docs.columns


def test_isotonic_pools_what_falls():
    got = quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1, 3, 1]))
    assert np.allclose(got, [0.1, 0.35, 0.35, 0.9])


def test_statistics_of_empty_texts_are_finite():
    for text in (None, b"", b" \n", b"a", b"\xc3\xa9" * 1000):
        assert np.isfinite(quality.statistics(text, WordHash())).all()
