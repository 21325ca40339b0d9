"""Removal of repeated passages: content-defined chunks of lines, global counts, byte comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seriesframe.llm.words import MULTIPLIER, in_pieces, mixed, texts_of
from seriesframe.sources.files import settle

#: Independent chunkings, lines a rolling hash spans, and one place in so many ends a chunk.
LAYERS, WINDOW, DIVISOR = 2, 3, 4
#: A chunk counts from so many lines and words on. A match is carried on over up to so many lines on both sides whose
#: 128-bit digests are equal; the digests travel with the chunk, and longer matches have further chunks.
LEAST_LINES, LEAST_WORDS, AROUND = 2, 10, 16


def cuts(hashes: np.ndarray, layer: int) -> np.ndarray:
    """Ends of the chunks of one chunking (exclusive line numbers, the last one included).

    The rolling hash of WINDOW lines decides whether a chunk ends there. Even layers look at the lines before the cut and
    odd ones at those behind it, so a passage's own lines decide about both of its edges. Lines put in or
    taken out elsewhere move no cut.
    """
    n = len(hashes)
    roll = np.full(n, layer + 1, np.uint64)
    for k in range(WINDOW):
        shifted = np.zeros(n, np.uint64)
        if layer % 2:
            shifted[: n - k] = hashes[k:]
        else:
            shifted[k:] = hashes[: n - k]
        roll = mixed(roll * MULTIPLIER + shifted)
    at = np.flatnonzero(roll % np.uint64(DIVISOR) == 0) + (0 if layer % 2 else 1)
    return np.unique(np.concatenate([at[at > 0], [n]]))


def _lines(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else []


def chunk_hash(line_hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(line_hashes.tobytes())).astype(np.int64))


def chunks(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """(hash, first line, number of lines) of all chunks that count, each once.

    Besides the content-defined chunks there are the shortest runs that count from each line on and up to each line. So
    all lines of any passage that counts lie in chunks inside of it, whatever stands around it.
    """
    if len(lines) < LEAST_LINES:
        return []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, count=len(lines))
    words = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
    places = np.arange(len(lines))
    onward = np.maximum(np.searchsorted(words, words[:-1] + LEAST_WORDS) - places, LEAST_LINES)
    fits = places + onward <= len(lines)
    found = set(zip(places[fits].tolist(), onward[fits].tolist()))
    back = np.minimum(np.searchsorted(words, words[1:] - LEAST_WORDS, "right") - 1, places + 1 - LEAST_LINES)
    fits = back >= 0
    found.update(zip(back[fits].tolist(), (places + 1 - back)[fits].tolist()))
    for layer in range(LAYERS):
        start = 0
        for end in cuts(hashes, layer).tolist():
            if end - start >= LEAST_LINES and words[end] - words[start] >= LEAST_WORDS:
                found.add((start, end - start))
            start = end
    return [(chunk_hash(hashes[s : s + n]), s, n) for s, n in sorted(found)]


CHUNKS = pa.list_(pa.struct([("chunk", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))


def _chunker() -> Callable:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            rows = [[{"chunk": h, "start": s, "n": n} for h, s, n in chunks(_lines(t))] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, CHUNKS)], names=["doc_id", "mark", "chunks"])

    return cut


EXTRACT = "chunk long, doc_id long, mark long, start int, n int, own boolean, before binary, body binary, after binary"


def _digests(lines: list[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh3_128_digest, lines))


def _needed(wanted: list[dict]) -> list[dict]:
    """First copies, and of the others as many as lead to all their lines.

    Chunks that lie in their documents as their first copies lie in theirs (``along``) and touch are one match. The lines
    around a chunk tell of AROUND more of it, so the next one is needed beyond them only.
    """
    out, reached = [w for w in wanted if w["own"]], {}
    for w in sorted((w for w in wanted if not w["own"]), key=lambda w: (w["start"], -w["n"])):
        end = w["start"] + w["n"]
        told, touching = reached.get(w["along"], (-1, -1))
        if w["start"] <= touching and end <= told:
            reached[w["along"]] = told, max(touching, end)
        else:
            reached[w["along"]] = end + AROUND, max(touching, end)
            out.append(w)
    return out


def _extractor() -> Callable:
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the wanted chunks, with the lines around them."""
        for batch in in_pieces(batches, 128):
            rows = []
            for doc_id, mark, text, wanted in zip(*(batch.column(k).to_pylist() for k in (0, 1)), texts_of(batch), batch.column(3).to_pylist()):
                lines = _lines(text)
                have = {(s, n): h for h, s, n in chunks(lines)}
                for w in _needed(wanted):
                    s, n = w["start"], w["n"]
                    if have.get((s, n)) == w["chunk"]:
                        rows.append({**w, "doc_id": doc_id, "mark": mark, "before": _digests(lines[max(0, s - AROUND) : s][::-1]),
                                     "body": b"\n".join(lines[s : s + n]), "after": _digests(lines[s + n : s + n + AROUND])})
            names = ("chunk", "doc_id", "mark", "start", "n", "own", "before", "body", "after")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=list(names))

    return extract


def _alike(x: bytes, y: bytes) -> int:
    """Leading digests that two rows of digests share."""
    n = min(len(x), len(y)) // 16
    return next((k for k in range(n) if x[16 * k : 16 * k + 16] != y[16 * k : 16 * k + 16]), n)


def _comparer() -> Callable:
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines that a later copy shares with the first one: the chunk, if its bytes are equal, and equal lines around it."""
        for batch in in_pieces(batches):
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():  # a bounded piece: small rows, and two bodies each
                if r["body"] != r["first_body"]:
                    continue
                up, down = _alike(r["before"], r["first_before"]), _alike(r["after"], r["first_after"])
                for c, v in zip(out, (r["doc_id"], r["mark"], r["start"] - up, r["n"] + up + down)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "mark", "start", "n"])

    return compare


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and a hash of the text: rows of one id with different texts are different documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("mark", F.xxhash64("text"))


def _with_row(docs: DataFrame, values: DataFrame, how: str) -> DataFrame:
    """Join on id and mark; missing ids are an id."""
    values = values.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
    return docs.join(values, docs["doc_id"].eqNullSafe(values["_id"]) & (docs["mark"] == values["_mark"]), how).drop("_id", "_mark")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark``, ``ranges`` (start line, number of lines): lines of each document that repeat an earlier passage.

    A document is an id with a text, ``mark`` the text's hash. The first copy of a chunk (smallest id, missing ids last, then
    mark and line) stays; all others are compared with it byte by byte. Counting is an aggregate per chunk hash,
    so a chunk that a third of all documents share is combined before it is shuffled; the first copies are written
    before the join, so skew handling can split the others.
    """
    docs = _marked(docs)
    found = docs.select("doc_id", "mark", "text").mapInArrow(
        _chunker(), "doc_id long, mark long, chunks array<struct<chunk:long,start:int,n:int>>"
    )
    found = settle(found.select("doc_id", "mark", F.inline("chunks")), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")
    repeated = found.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    repeated = settle(repeated.select("chunk", "first"), "repeated")
    own = place.eqNullSafe(F.col("first"))
    along = F.xxhash64("first.doc_id", "first.mark", F.col("start") - F.col("first.start"))
    wanted = found.join(repeated, "chunk").select("doc_id", "mark", "chunk", "start", "n", own.alias("own"), along.alias("along"))
    # As many as one text has chunks.
    wanted = wanted.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("chunk", "start", "n", "own", "along")).alias("wanted"))
    held = _with_row(docs, wanted, "inner").select("doc_id", "mark", "text", "wanted")
    extracts = settle(held.mapInArrow(_extractor(), EXTRACT), "extracts")
    first = extracts.filter("own").select("chunk", *[F.col(c).alias(f"first_{c}") for c in ("before", "body", "after")])
    first = settle(first.dropDuplicates(["chunk"]), "first")
    pairs = extracts.filter("not own").drop("own").join(first, "chunk")
    ranges = pairs.mapInArrow(_comparer(), "doc_id long, mark long, start int, n int").distinct()
    return ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


RESULT = "doc_id long, n_lines int, removed array<int>, text string"


def _remover() -> Callable:
    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            out: list[list] = [[], [], []]
            for text, ranges in zip(texts_of(batch), batch.column(2).to_pylist()):
                lines = _lines(text)
                gone = sorted({k for r in ranges or [] for k in range(max(0, r["start"]), min(len(lines), r["start"] + r["n"]))})
                drop = set(gone)
                out[0].append(len(lines))
                out[1].append(gone)
                out[2].append(None if text is None else b"\n".join(x for k, x in enumerate(lines) if k not in drop).decode())
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=["doc_id", "n_lines", "removed", "text"]
            )

    return remove


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_lines``, ``removed`` (numbers of the lines taken out, from 0), ``text`` (the rest).

    Lines end at line feeds. Chunks of at least LEAST_LINES lines and LEAST_WORDS words that stand in several places of
    the table lose all copies but the first, together with equal lines around them. Single repeated lines stay.

    Null texts stay null and empty ones empty, both without lines. Rows with one id and different texts are different
    documents; rows with one id and one text are one document, in each of which the first copy stays. Rows without an id are
    told apart by their texts and come after the others. An empty table gives no rows. Other columns are not read.
    Texts are read whole.
    """
    ranges = repeated_lines(docs)
    return _with_row(_marked(docs), ranges, "left").select("doc_id", "text", "ranges").mapInArrow(_remover(), RESULT)
