"""Quality classifier: random Fourier features of document statistics, ridge from summed normal equations, isotonic scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seriesframe.llm.words import WordHash, hashes_of, in_pieces, mixed, texts_of
from seriesframe.sources.files import settle

#: Random features, kernel width in units of the root of the number of statistics, ridge per row.
FEATURES, WIDTH, RIDGE = 384, 0.7, 1e-4
#: Bins of the raw score in which labels are counted for the isotonic fit.
BINS = 2_000
#: Bytes counted apart.
SYMBOLS = [np.frombuffer(s, np.uint8) for s in (b"#$%&*@^~", b"|", b"!", b"<>{}[]\\/=+_`", b".,;:?'\"()-")]
STATISTICS = 29


def statistics(text: bytes | None, memo: WordHash) -> np.ndarray:
    """Numbers that describe the whole text: length, kinds of bytes, words and how they repeat, lines. Null is empty."""
    text = text or b""
    out = np.zeros(STATISTICS)
    size, words = len(text), text.split()
    n = len(words)
    out[0:2] = np.log1p(size), np.log1p(n)
    if not n:
        out[2] = 1
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    visible = max(1, size - counts[32] - counts[9:14].sum())
    out[3:8] = [counts[s].sum() / visible for s in SYMBOLS]
    out[8:12] = counts[65:91].sum() / visible, counts[48:58].sum() / visible, counts[128:].sum() / visible, counts[10] / n
    share = counts[counts > 0] / size
    out[12] = -(share * np.log(share)).sum()
    lengths = np.fromiter(map(len, words), np.float64, count=n)
    out[13:17] = lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 12).mean()
    h = hashes_of(words, memo)
    _, times = np.unique(h, return_counts=True)
    share = times / n
    out[17:20] = len(times) / n, share.max(), -(share * np.log(share)).sum() / np.log(n + 1)
    out[20] = (h[1:] == h[:-1]).mean() if n > 1 else 0
    pairs = mixed(h[1:] * np.uint64(31) + h[:-1])
    out[21] = len(np.unique(pairs)) / max(1, len(pairs))
    lines = text.split(b"\n")
    kinds = set(lines)
    out[22:25] = len(kinds) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines))
    out[25:29] = (
        sum(map(bytes.isupper, words)) / n,
        np.log1p(counts[46] * 100 / n),
        sum(map(bytes.istitle, words)) / n,
        max(map(len, lines)) / size,
    )
    return out


def _describer() -> Callable:
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in in_pieces(batches):
            found = [statistics(t, memo) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return describe


@dataclass
class Model:
    """Everything a score needs: scaling, random directions, ridge weights, isotonic steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([out, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated share of good labels; a thousandth of the raw score orders rows on one step."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _summer(model: Model) -> Callable:
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Normal equations of a partition, apart for the two folds."""
        d = FEATURES + 1
        total = np.zeros((2, d, d + 1))
        for batch in batches:
            z = model.expand(np.array(batch.column(0).to_pylist()).reshape(-1, STATISTICS))
            y = np.array(batch.column(1).to_pylist(), float)
            fold = np.array(batch.column(2).to_pylist())
            for k in (0, 1):
                own = fold == k
                total[k] += z[own].T @ np.hstack([z[own], y[own, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sums


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"sums": [sum(np.frombuffer(x) for x in rows["sums"]).tobytes()]})


def _binner(model: Model, by_fold: list[np.ndarray]) -> Callable:
    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Labels by bin of the score that the other fold's weights give."""
        for batch in batches:
            z = model.expand(np.array(batch.column(0).to_pylist()).reshape(-1, STATISTICS))
            fold = np.array(batch.column(2).to_pylist(), int)
            raw = np.where(fold == 0, z @ by_fold[1], z @ by_fold[0])
            place = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["bin", "y"])

    return bins


def isotonic(level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for y, w in zip(level, weight):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks[-1]
            blocks[-1] = [(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([[y] * n for y, _, n in blocks]) if blocks else np.empty(0)


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def described(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_describer(), "doc_id long, x array<double>")


def fit(statistics_of_docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labelled rows that are not held out (crc32 of the id as text, modulo 3, is 1).

    Ridge weights come from normal equations summed per partition and then in groups of partitions. The isotonic
    steps come from scores that each half of the rows gets from the other half's weights, counted in BINS bins.
    Without labelled rows every score is 0.5.
    """
    spark = statistics_of_docs.sparkSession
    labels = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y"))
    fold = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % 2
    rows = (
        statistics_of_docs.filter(~held_out("doc_id"))
        .join(labels, F.col("doc_id") == F.col("labelled"))
        .select("x", "y", fold.cast("long").alias("fold"))
    )
    rows = settle(rows, "labelled")
    moments = rows.agg(
        F.count("*"),
        *[f(F.element_at("x", k + 1)) for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)],
    ).first()
    rng = np.random.default_rng(3)
    directions = rng.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS))
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    numbers = np.array([0.0 if v is None else v for v in moments[1:]]).reshape(STATISTICS, 2)
    scale = np.where(numbers[:, 1] > 1e-9, numbers[:, 1], 1.0)
    empty = np.zeros(FEATURES + 1)
    model = Model(numbers[:, 0], scale, directions, phases, empty, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not moments[0]:
        return model
    groups = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    parts = rows.mapInArrow(_summer(model), "sums binary").withColumn("group", F.spark_partition_id() % groups)
    summed = parts.groupBy("group").applyInPandas(_add, "sums binary").collect()
    d = FEATURES + 1
    folds = sum(np.frombuffer(r.sums) for r in summed).reshape(2, d, d + 1)

    def solved(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[:, :d] + RIDGE * max(1.0, total[-1, d - 1]) * np.eye(d), total[:, d])

    model.weights = solved(folds.sum(axis=0))
    by_fold = [solved(folds[0]), solved(folds[1])]
    counted = (
        rows.mapInArrow(_binner(model, by_fold), "bin long, y double")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("y").alias("good"))
        .orderBy("bin")
        .collect()
    )
    n, good = np.array([r.n for r in counted], float), np.array([r.good for r in counted], float)
    model.knots = (np.array([r.bin for r in counted]) + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic(good / n, n)
    return model


def _scorer(model: Model) -> Callable:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Scores depend on the whole text alone. Null and empty texts get the score of an empty text. Rows that repeat an id
    are scored each; labels that repeat an id count each; labels other than 0 and 1 are left out. Null ids are scored.
    Texts are read once, their statistics are written to the shared folder.
    """
    found = settle(described(docs), "statistics")
    model = fit(found, labels)
    return found.mapInArrow(_scorer(model), "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _keeper(model: Model) -> Callable:
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in in_pieces(batches):
            x = np.array([statistics(t, memo) for t in texts_of(batch)])
            yield batch.filter(pa.array(model.score(x) >= 0.5, pa.bool_()))

    return keep


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier predicts to be good."""
    model = fit(settle(described(docs), "statistics"), labels)
    return docs.mapInArrow(_keeper(model), docs.schema)
