"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by scaled forward recursion."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seriesframe.llm.sharing import received, sent
from seriesframe.llm.words import fold, in_pieces, texts_of, words_of
from seriesframe.sources.files import settle

STATES = 8
#: Words with a class of their own (the most frequent ones), and classes by shape for all others.
OWN, SHAPES = 32_256, 512
#: Steps on the sample that gives the start, its size, and steps over all training texts.
START_STEPS, START_TEXTS, STEPS = 12, 1_500, 3
#: Training sequences are cut after so many tokens, which bounds the memory of a step; scoring cuts nothing.
SEGMENT = 1_024
#: Weight, in tokens, that each state's emissions give to the overall frequencies.
PRIOR = 50.0
MEMO_WORDS = 300_000
#: The end token; no word can hold a space.
END = b" "


def shape(word: bytes) -> int:
    """Class of a word by length, kinds of bytes and ending."""
    length = min(3, max(0, len(word) - 1) // 4)
    kinds = (not word.isalnum()) + 2 * any(48 <= b < 58 for b in word) + 4 * (not word.isascii())
    return (length * 8 + kinds) * 16 + xxhash.xxh3_64_intdigest(word.rstrip(b".,;:!?")[-2:]) % 16


class Coder(dict):
    """Word to a 64-bit code: a hash whose last nine bits are the word's shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = (xxhash.xxh3_64_intdigest(word) & ~(SHAPES - 1)) | shape(word)
        self[word] = code = h - 2**64 if h >= 2**63 else h
        return code


class Classes(dict):
    """Word to its class, given the classes of the most frequent codes."""

    def __init__(self, own: dict[int, int]):
        super().__init__()
        self.own, self.coder = own, Coder()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self.coder[word]
        self[word] = value = self.own.get(code, OWN + (code & (SHAPES - 1)))
        return value


def _counter() -> Callable:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the training texts' tokens, one row per code and piece."""
        coder = Coder()
        for batch in in_pieces(batches, 2_048):
            codes = [
                np.fromiter(map(coder.__getitem__, words + [END]), np.int64, count=len(words) + 1)
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch))
                if fold(doc_id) % 10 != 0
                for words in [words_of(text)]
            ]
            if codes:
                kinds, times = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(times, pa.int64())], names=["code", "n"])

    return count


@dataclass
class Unigrams:
    """Counts that fit on the driver: of the most frequent codes and of the shapes of all others."""

    own: dict[int, int]
    own_counts: np.ndarray
    shape_counts: np.ndarray
    shape_kinds: np.ndarray
    tokens: int
    kinds: int

    @property
    def mass(self) -> float:
        return self.tokens + 0.1 * (self.kinds + 1)

    @property
    def logs(self) -> np.ndarray:
        """log10 of the base probability of each class. A shape's class holds its words and one unknown word."""
        own = np.full(OWN, 0.1)
        own[: len(self.own_counts)] += self.own_counts
        rest = self.shape_counts + 0.1 * self.shape_kinds + 0.1
        return np.log10(np.concatenate([own, rest]) / self.mass)


@dataclass
class Chain:
    """Start of a text, start of a later segment, transitions and emissions (states x classes)."""

    first: np.ndarray
    later: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def _laid_out(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first, tokens by time: order, tokens, and the number of sequences that reach each time."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    starts = np.cumsum(active) - active
    tokens = np.empty(lengths.sum(), np.int64)
    for rank, k in enumerate(order):
        tokens[starts[: lengths[rank]] + rank] = sequences[k]
    return order, tokens, active


def log_likelihoods(chain: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each whole sequence's probability: the forward recursion, scaled to sum 1 at each token."""
    out = np.zeros(len(sequences))
    if not sequences:
        return out
    order, tokens, active = _laid_out(sequences)
    emits = np.ascontiguousarray(chain.emits.T)
    total, alpha, at = np.zeros(len(sequences)), np.tile(chain.first, (len(sequences), 1)), 0
    for t, n in enumerate(active.tolist()):
        alpha = (alpha[:n] @ chain.moves if t else alpha) * emits[tokens[at : at + n]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
        at += n
    out[order] = total
    return out


class Expected:
    """Expected counts of a set of sequences under a chain, added up."""

    def __init__(self, classes: int):
        self.first, self.later = np.zeros(STATES), np.zeros(STATES)
        self.moves, self.emits = np.zeros((STATES, STATES)), np.zeros((STATES, classes))

    def add(self, chain: Chain, sequences: list[np.ndarray], begins: np.ndarray) -> None:
        """``begins`` tells which sequences are the start of a text."""
        if not sequences:
            return
        order, tokens, active = _laid_out(sequences)
        begins = begins[order]
        emits = np.ascontiguousarray(chain.emits.T.astype(np.float32))[tokens]
        moves, total = chain.moves.astype(np.float32), len(tokens)
        alphas, scales = np.empty((total, STATES), np.float32), np.empty(total, np.float32)
        starts = np.cumsum(active) - active
        alpha = np.where(begins[:, None], chain.first, chain.later).astype(np.float32)
        for t, (at, n) in enumerate(zip(starts.tolist(), active.tolist())):
            alpha = (alpha[:n] @ moves if t else alpha) * emits[at : at + n]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            alphas[at : at + n], scales[at : at + n] = alpha, scale
        beta, pairs = np.ones((len(sequences), STATES), np.float32), np.zeros((STATES, STATES))
        back = np.ascontiguousarray(moves.T)
        for t in range(len(active) - 1, 0, -1):
            at, n, before = starts[t], active[t], starts[t - 1]
            ahead = emits[at : at + n] * beta[:n] / scales[at : at + n, None]
            pairs += alphas[before : before + n].T @ ahead
            alphas[at : at + n] *= beta[:n]
            beta[:n] = ahead @ back
        alphas[: active[0]] *= beta
        self.moves += chain.moves * pairs
        self.first += alphas[: active[0]][begins].sum(axis=0)
        self.later += alphas[: active[0]][~begins].sum(axis=0)
        for s in range(STATES):
            self.emits[s] += np.bincount(tokens, alphas[:, s], self.emits.shape[1])

    def chain(self, base: np.ndarray) -> Chain:
        """Maximisation, with a little of the overall frequencies in every distribution."""
        first = self.first + 1
        later = self.later + 1
        moves = self.moves + 1
        emits = self.emits + PRIOR * base
        return Chain(
            first / first.sum(), later / later.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True)
        )


def _segments(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [(x[at : at + SEGMENT], at == 0) for x in texts for at in range(0, len(x), SEGMENT)]
    return [p for p, _ in parts], np.array([b for _, b in parts], bool)


def _decoded(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch.column(batch.schema.get_field_index("classes")).to_pylist()]


def start_chain(base: np.ndarray, sample: list[np.ndarray]) -> Chain:
    """Random word groups as states, then steps on the sample. The same on every run."""
    rng = np.random.default_rng(10)
    emits = base * rng.lognormal(0, 1.0, (STATES, len(base)))
    moves = np.full((STATES, STATES), 0.4 / STATES) + 0.6 * np.eye(STATES)
    even = np.full(STATES, 1 / STATES)
    chain = Chain(even, even, moves, emits / emits.sum(axis=1, keepdims=True))
    parts, begins = _segments(sample)
    for _ in range(START_STEPS if parts else 0):
        counts = Expected(len(base))
        counts.add(chain, parts, begins)
        chain = counts.chain(base)
    return chain


def _encoder(shared) -> Callable:
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = received(shared)
        classes = Classes(own)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in in_pieces(batches):
            columns: list[list] = [[] for _ in kinds]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                words = words_of(text) + [END]
                own_class = np.fromiter(map(classes.__getitem__, words), np.int64, count=len(words))
                other = own_class >= OWN
                rare, times = np.unique(
                    np.fromiter(map(classes.coder.__getitem__, compress(words, other.tolist())), np.int64), return_counts=True
                )
                value = logs[own_class]
                row = (doc_id, fold(doc_id) % 10 == 0, len(words), int((~other).sum()), value[~other].sum(), value[other].sum(),
                       own_class.astype(np.uint16).tobytes(), rare, times)
                for c, x in zip(columns, row):
                    c.append(x)
            names = ["doc_id", "held_out", "n_tokens", "own_known", "own_base", "shape_base", "classes", "rare", "times"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return encode


def _expecter(shared) -> Callable:
    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Expected counts of a partition: a row of one number per state for each class and each other distribution."""
        chain: Chain = received(shared)
        classes = chain.emits.shape[1]
        counts = Expected(classes)
        for batch in in_pieces(batches, 1_024):
            parts, begins = _segments(_decoded(batch))
            for at in range(0, len(parts), 2_048):
                counts.add(chain, parts[at : at + 2_048], begins[at : at + 2_048])
        rows = np.vstack([counts.emits.T, counts.moves, counts.first, counts.later])
        some = np.flatnonzero(rows.any(axis=1))
        values = [pa.array(rows[some, s]) for s in range(STATES)]
        yield pa.RecordBatch.from_arrays([pa.array(some), *values], names=["row", *[f"s{s}" for s in range(STATES)]])

    return expect


def trained(encoded: DataFrame, unigrams: Unigrams) -> Chain:
    """STEPS of Baum-Welch over all training texts; the sums of each step are one row per class, so their size is fixed."""
    spark = encoded.sparkSession
    base = 10**unigrams.logs
    train = encoded.filter("not held_out").select("classes")
    texts = train.count()
    drawn = F.pmod(F.xxhash64("classes"), F.lit(2**40)) < 2**40 * min(1.0, 4 * START_TEXTS / max(texts, 1))
    by_hash = train.filter(drawn).orderBy(F.xxhash64("classes"), "classes").limit(START_TEXTS)
    sample = [np.frombuffer(r.classes, np.uint16).astype(np.int64) for r in by_hash.collect()]
    chain = start_chain(base, sample)
    columns = [f"s{s}" for s in range(STATES)]
    for _ in range(STEPS):
        parts = train.mapInArrow(_expecter(sent(spark, chain)), "row long, " + ", ".join(f"{c} double" for c in columns))
        summed = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        rows = np.zeros((len(base) + STATES + 2, STATES))
        rows[summed["row"].to_numpy()] = summed[columns].to_numpy()
        counts = Expected(len(base))
        counts.emits, counts.moves = rows[: len(base)].T, rows[len(base) : len(base) + STATES]
        counts.first, counts.later = rows[-2], rows[-1]
        chain = counts.chain(base)
    return chain


def _most_frequent(counts: DataFrame) -> list:
    """The OWN most frequent codes. Counts per octave sixteenth give a floor first, so that no more than these and the
    codes just under them are sorted and sent to the driver, from however many partitions."""
    octave = F.floor(F.log2("c") * 16)
    sizes = sorted(((r.o, r["count"]) for r in counts.groupBy(octave.alias("o")).count().collect()), reverse=True)
    reached = np.cumsum([n for _, n in sizes])
    floor = sizes[min(int(np.searchsorted(reached, OWN)), len(sizes) - 1)][0] if sizes else 0
    return counts.filter(octave >= floor).orderBy(F.desc("c"), "code").limit(OWN).collect()


def _scorer(shared) -> Callable:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = received(shared)
        for batch in in_pieces(batches, 1_024):
            found = log_likelihoods(chain, _decoded(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["row_id", "chain_score"])

    return score


def scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the whole text's words, A-Z in lower case, then one end token. Rows whose crc32(id as text) modulo 10 is not 0
    are for training. ``base_score`` is the smoothed unigram log10 probability with counts of all training tokens.

    ``score`` is the log10 probability under a hidden Markov chain that emits word classes: each of the OWN most frequent
    words is a class, all others share classes by shape, and within a class words keep their base probabilities. A
    shape's class also holds one unknown word, so probabilities add up to 1. Classes have a fixed number, so the chain
    and its counts do not grow with the corpus; rare words' counts do and are joined by their code, never broadcast.
    Codes are hashes of 64 bits.

    Null texts are empty: one end token. Null ids count as the text ``null``. Repeated rows count and are scored each. An
    empty table gives no rows; without training rows the base knows no word. The texts are read twice, once to count
    and once to encode; the encoded rows lie in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = settle(docs.mapInArrow(_counter(), "code long, n long").groupBy("code").agg(F.sum("n").alias("c")), "counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _most_frequent(counts)
    own = {r.code: k for k, r in enumerate(top)}
    last = (top[-1].c, top[-1].code) if top else (0, 0)
    others = counts.filter((F.col("c") < last[0]) | ((F.col("c") == last[0]) & (F.col("code") > last[1])))
    shapes = others.groupBy(F.col("code").bitwiseAND(F.lit(SHAPES - 1)).alias("shape")).agg(F.sum("c").alias("c"), F.count("*").alias("kinds"))
    shape_counts, shape_kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in shapes.collect():
        shape_counts[r["shape"]], shape_kinds[r["shape"]] = r.c, r.kinds
    unigrams = Unigrams(own, np.array([r.c for r in top], float), shape_counts, shape_kinds, tokens, kinds)

    schema = "doc_id long, held_out boolean, n_tokens long, own_known long, own_base double, shape_base double, classes binary, rare array<long>, times array<long>"
    encoded = docs.mapInArrow(_encoder(sent(spark, (own, unigrams.logs))), schema)
    encoded = settle(encoded.withColumn("row_id", F.monotonically_increasing_id()), "encoded")
    chain = trained(encoded, unigrams)

    rare = encoded.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row_id", F.col("r.rare").alias("code"), F.col("r.times").alias("times")
    )
    worth = F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(unigrams.mass))
    rare = (
        rare.join(others, "code", "left")
        .select("row_id", worth.alias("worth"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("known"))
        .groupBy("row_id")
        .agg(F.sum("worth").alias("rare_base"), F.sum("known").alias("rare_known"))
    )
    chained = encoded.select("row_id", "classes").mapInArrow(
        _scorer(sent(spark, chain)), "row_id long, chain_score double"
    )
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    return (
        encoded.select("row_id", "doc_id", "held_out", "n_tokens", "own_known", "own_base", "shape_base")
        .join(chained, "row_id")
        .join(rare, "row_id", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("own_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("own_base") + rare_base).alias("base_score"),
            (F.col("chain_score") - F.col("shape_base") + rare_base).alias("score"),
        )
    )
