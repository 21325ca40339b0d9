"""Benchmark decontamination: a BM25 index of the test items, searched with every passage of the training texts."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seriesframe.llm.sharing import received, sent
from seriesframe.llm.words import WordHash, hashes_of, in_pieces, shingles, texts_of, words_of

#: Usual BM25 constants.
K1, B = 1.2, 0.75
#: Items of a block whose largest weights are kept per term.
BLOCK = 64
#: Bytes of item texts that one index holds; more items are searched index by index.
INDEX_BYTES = 8_000_000
WORD = r"[^\x20\x09-\x0D]+"


def split_item(words: list) -> tuple[list, list]:
    """Question and answer: up to the first word that ends in a question mark, else halves (the question gets the odd word)."""
    at = next((i + 1 for i, w in enumerate(words) if w.endswith(b"?")), 0)
    at = at if 0 < at < len(words) else (len(words) + 1) // 2
    return words[:at], words[at:]


class Index:
    """Posting lists with weights relative to an item's own full score, thresholds, and maxima per block of items.

    ``least[i]`` is a score that no passage stays under if at most (100 - share) % of item i's shingles are missing
    from it: a missing word takes at least one shingle with it, so at most that many words, at worst the heaviest
    ones, are missing. Retrieval above the threshold therefore finds everything that the overlap test could accept.
    """

    def __init__(self, items: list[tuple[int, bytes]], df: dict[bytes, int], count: int, mean: float, size: int, share: int):
        memo = WordHash()
        self.size, self.share, self.ids = size, share, [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.longest = max([len(w) for w in texts], default=1) or 1
        self.parts = [[np.unique(shingles(hashes_of(p, memo), size)) for p in split_item(w)] for w in texts]
        postings, self.least, sets = defaultdict(list), np.zeros(len(items)), []
        for k, words in enumerate(texts):
            tf = defaultdict(int)
            for w in words:
                tf[w] += 1
            idf = {w: math.log(1 + (count - df[w] + 0.5) / (df[w] + 0.5)) for w in tf}
            norm = K1 * (1 - B + B * len(words) / max(mean, 1e-9))
            weights = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            full = sum(weights.values()) or 1.0
            whole = len(np.unique(shingles(hashes_of(words, memo), size)))
            lost = sorted(weights.values(), reverse=True)[: whole * (100 - share) // 100]
            self.least[k] = max(0.0, (full - sum(lost)) / full - 1e-9)
            sets.append({w: x / full for w, x in weights.items()})
            for w, x in sets[-1].items():
                postings[w].append((k, x))
        terms = sorted(postings, key=lambda w: (-len(postings[w]), w))
        self.term = {w: i for i, w in enumerate(terms)}
        self.weights = [{self.term[w]: x for w, x in s.items()} for s in sets]
        # The longest lists are left for last: what they can add to an item stays under half its threshold.
        dense_sum, self.dense = np.zeros(len(items)), np.zeros(len(terms), bool)
        for t, w in enumerate(terms):
            own = np.array([k for k, _ in postings[w]])
            x = np.array([x for _, x in postings[w]])
            if len(own) > 1 and (dense_sum[own] + x < 0.5 * self.least[own]).all():
                dense_sum[own] += x
                self.dense[t] = True
        self.rest = dense_sum
        sparse = [(t, postings[w]) for t, w in enumerate(terms)]
        self.start = np.cumsum([0] + [0 if self.dense[t] else len(p) for t, p in sparse])
        flat = [e for t, p in sparse if not self.dense[t] for e in p]
        self.item = np.array([k for k, _ in flat], np.int64)
        self.weight = np.array([x for _, x in flat], np.float64)
        blocks = -(-len(items) // BLOCK)
        row = np.cumsum(self.dense) - 1
        self.row = np.where(self.dense, row, -1)
        self.block_most = np.zeros((int(self.dense.sum()), max(blocks, 1)), np.float32)
        for t, p in sparse:
            if self.dense[t]:
                for k, x in p:
                    self.block_most[row[t], k // BLOCK] = max(self.block_most[row[t], k // BLOCK], np.float32(x * 1.000001))

    def search(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, float]]:
        """(text, passage, item, score) for every passage and item at or above the item's threshold.

        A passage is two neighbouring stretches of as many words as the longest item has, so an item that stands in a
        text lies whole in one of them. The sparse lists give partial scores; a pair goes on while partial score
        and the bound of the long lists (first their total, then their maxima in the item's block) reach the
        threshold; only then the long lists are added exactly.
        """
        lengths = np.array([len(w) for w in texts], np.int64)
        if not lengths.sum() or not self.ids:
            return
        get = self.term.get
        ids = np.concatenate([np.fromiter(map(get, w, repeat(-1)), np.int64, count=len(w)) for w in texts])
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        cells = -(-lengths // self.longest) + 1
        first = np.cumsum(cells) - cells
        stretch = inside // self.longest
        known = ids >= 0
        cell, ids, stretch = (np.repeat(first, lengths) + stretch)[known], ids[known], stretch[known]
        terms = len(self.term)
        earlier = stretch > 0
        seen = np.unique(np.concatenate([cell * terms + ids, (cell[earlier] - 1) * terms + ids[earlier]]))
        passage, term = seen // terms, seen % terms
        sparse = ~self.dense[term]
        p, t = passage[sparse], term[sparse]
        n = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, place = np.unique(np.repeat(p, n) * len(self.ids) + self.item[at], return_inverse=True)
        partial = np.bincount(place, self.weight[at], len(key))
        where, item = key // len(self.ids), key % len(self.ids)
        keep = partial + self.rest[item] >= self.least[item]
        for w, k, score in zip(where[keep].tolist(), item[keep].tolist(), partial[keep].tolist()):
            lo, hi = np.searchsorted(passage, [w, w + 1])
            rows = self.row[term[lo:hi]]
            if score + self.block_most[rows[rows >= 0], k // BLOCK].sum(dtype=np.float64) < self.least[k]:
                continue
            own = self.weights[k]
            score = sum(own.get(x, 0.0) for x in term[lo:hi].tolist())
            if score >= self.least[k]:
                text = int(np.searchsorted(first, w, side="right")) - 1
                yield text, w - int(first[text]), k, score

    def overlap(self, words: list[bytes], passage: int, k: int, memo: WordHash) -> tuple[int, int]:
        """Shingles of the item's question and answer that stand in the passage."""
        own = words[passage * self.longest : (passage + 2) * self.longest]
        have = hashes_of(own, memo)
        out = []
        for part in self.parts[k]:
            size = self.size if len(part) != 1 else None
            found = np.unique(shingles(have, self.size))
            if size is None:  # a part of fewer words than a shingle is one sequence of unknown length
                found = np.unique(np.concatenate([shingles(have, s) for s in range(1, self.size + 1)]))
            out.append(int(np.isin(part, found, assume_unique=True).sum()))
        return out[0], out[1]

    def matches(self, texts: list[list[bytes]]) -> dict[tuple[int, int], tuple[int, int, float]]:
        """For (text, item): overlap and score of the passage that holds most of the item, if it holds enough.

        Enough: ``share`` % of the item's shingles, and half of those of the question and of the answer.
        """
        memo, out = WordHash(), {}
        for text, passage, k, score in self.search(texts):
            q, a = self.overlap(texts[text], passage, k, memo)
            nq, na = map(len, self.parts[k])
            if 100 * (q + a) >= self.share * (nq + na) and 2 * q >= nq and 2 * a >= na:
                best = out.get((text, k))
                if not best or q + a > best[0] + best[1]:
                    out[text, k] = (q, a, score)
        return out


def _indexes(benchmark: DataFrame, size: int, share: int) -> Iterator[Index]:
    """Indexes over all items, each of bounded size, with statistics of all items."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn("words", F.regexp_extract_all(lower, F.lit(WORD), 0)).filter("size(words) > 0")
    total, count, words = items.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))
    ).first()
    blocks = -(-total // INDEX_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    frequencies = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    for k in range(blocks):
        own = items.filter(block == k)
        used = own.select(F.explode("words").alias("word")).distinct()
        df = {r.word.encode(): r.n for r in frequencies.join(used, "word").collect()}
        rows = sorted(((r.item_id, r.text.encode()) for r in own.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x))
        yield Index(rows, df, count, words / count, size, share)


def _finder(shared) -> Callable:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared)
        for batch in in_pieces(batches, 256):
            ids = batch.column(0).to_pylist()
            found = index.matches([words_of(t) for t in texts_of(batch)])
            rows = [
                {"doc_id": ids[d], "item_id": index.ids[k], "n_question": len(index.parts[k][0]), "n_answer": len(index.parts[k][1]),
                 "question_found": q, "answer_found": a, "score": s}
                for (d, k), (q, a, s) in found.items()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=MATCH)

    return find


MATCH = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "item_id", "n_question", "n_answer", "question_found", "answer_found")] + [("score", pa.float64())]
)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """One row per row of ``docs`` and test item that it contains: ``doc_id``, ``item_id``, numbers of shingles of the item's
    question and answer and of those found, and ``score`` (BM25 of the item for the passage, 1 for the item itself).

    Every passage of every text is a query; see ``Index.search`` and ``Index.matches``. Texts are read whole.
    The texts are not shuffled: each index (at most INDEX_BYTES of items, so its broadcast is bounded) is one pass.
    Null and empty texts and items match nothing; with no items the result is empty. Repeated items and repeated rows
    give a row each. Null ids are carried. Only the columns named are read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_question long, n_answer long, question_found long, answer_found long, score double"
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, size, share):
        out = out.unionByName(docs.mapInArrow(_finder(sent(spark, index)), schema))
    return out


def _cleaner(shared) -> Callable:
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared)
        for batch in in_pieces(batches, 256):
            found = {d for d, _ in index.matches([words_of(t) for t in texts_of(batch)])}
            yield batch.filter(pa.array([k not in found for k in range(batch.num_rows)], pa.bool_()))

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no test item; rows never leave their task."""
    for index in _indexes(benchmark, size, share):
        docs = docs.mapInArrow(_cleaner(sent(docs.sparkSession, index)), docs.schema)
    return docs
