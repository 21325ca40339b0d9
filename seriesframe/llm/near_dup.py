"""Near duplicates: universal hash minima with banding, checks on full sets, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from seriesframe.llm.components import components
from seriesframe.llm.sharing import unused
from seriesframe.llm.words import MULTIPLIER, WordHash, in_pieces, mixed, shingle_set, texts_of, values_of, words_of
from seriesframe.sources.files import settle

#: 32 bands of 5 minima: two sets of similarity 0.8 share no band with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Texts of a bucket that are compared in one tile, by number and by shingles; larger buckets get more tiles.
TILE_TEXTS, TILE_SHINGLES = 1_000, 1_000_000


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and shifts of the universal family x -> a x + b modulo 2^32, a odd."""
    rng = np.random.default_rng(20_240_817)
    n = BANDS * ROWS
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of every hash function over a set."""
    top, out = (items >> np.uint64(32)).astype(np.uint32), np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(top), 1024):
        out = np.minimum(out, np.minimum.reduce(top[at : at + 1024, None] * a + b, axis=0))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = mixed(h * MULTIPLIER + column)
    return h


def _sketcher(size: int) -> Callable:
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (a, b) = WordHash(), _hashers()
        for batch in in_pieces(batches):
            counts, marks, keys = [], [], []
            for text in texts_of(batch):
                items = shingle_set(words_of(text), size, memo)
                counts.append(len(items))
                marks.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                keys.append(band_keys(minima(items, a, b)).view(np.int64) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "mark", "bands"],
            )

    return sketch


def _setter(size: int) -> Callable:
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in in_pieces(batches):
            items = [shingle_set(words_of(text), size, memo).tobytes() for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], names=["node", "items"])

    return sets


def _linker(share: int) -> Callable:
    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the pairs whose full sets are similar enough."""
        for batch in in_pieces(batches):
            left = [np.frombuffer(x, np.uint64) for x in values_of(batch, "items_a")]
            right = [np.frombuffer(x, np.uint64) for x in values_of(batch, "items_b")]
            keep = []
            for x, y in zip(left, right):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= share * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a tile: a product of 0/1 matrices over the items that two sets share."""
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = times > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        ones = np.zeros((len(sets), width), np.float32)
        ones[owner[lo:hi], column[lo:hi] - at] = 1
        out += ones @ ones.T
    return out.astype(np.int64)


def _tiler(share: int) -> Callable:
    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between components within one tile: each component that joins another, with the least one it joins."""
        rows = rows.drop_duplicates("node")
        sets = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        sizes = np.array([len(x) for x in sets], np.int64)
        common = overlaps(sets)
        near = 100 * common >= share * (sizes[:, None] + sizes[None, :] - common)
        kinds, start = np.unique(rows["component"].to_numpy(), return_inverse=True)
        label = start.copy()
        while True:
            least = np.where(near, label[None, :], len(kinds)).min(axis=1)
            of_kind = np.arange(len(kinds))
            np.minimum.at(of_kind, start, np.minimum(least, label))
            moved = np.minimum(of_kind[start], of_kind[label])
            if (moved == label).all():
                break
            label = moved
        changed = label != start
        return pd.DataFrame({"a": kinds[start[changed]], "b": kinds[label[changed]]}).drop_duplicates()

    return tile


def near_duplicates(docs: DataFrame, size: int = 5, share: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    A text's set holds its distinct runs of ``size`` lower-cased words (shorter texts: the whole sequence).
    Two texts are linked if 100 * |intersection| >= ``share`` * |union|; ``component_id`` is the smallest id
    reachable over links and ``kept`` marks the row whose id that is.

    1. Rows with equal sets form one class with one representative, so copies never meet as pairs.
    2. Representatives that share a band fall into one bucket. Each is compared, on full sets, with the bucket's
       smallest one only, and links give components.
    3. Buckets that still hold several components are compared completely, in tiles of bounded size that return
       links between components and never pairs. So no link is lost, and no bucket is limited.

    Empty and null texts have no shingles and no links. Rows with a null id take no part: ``component_id`` null,
    ``kept`` true. Rows that repeat an id are one node, each keeps its own row. Other columns are not read.
    Texts are read whole. The result needs one more pass over the texts for those that share a bucket.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = settle(
        docs.mapInArrow(_sketcher(size), "doc_id long, n_shingles long, mark binary, bands array<long>"), "sketches"
    )
    usable = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = settle(usable.groupBy("mark").agg(F.min("doc_id").alias("node")), "classes")
    keys = (
        usable.join(classes, "mark")
        .filter("doc_id = node")
        .select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n"))
    )
    keys = settle(keys, "bands")
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top")
    members = settle(keys.join(buckets.select("key", "pivot"), "key"), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = settle(
        docs.join(wanted, "doc_id").mapInArrow(_setter(size), "node long, items binary").dropDuplicates(["node", "items"]),
        "sets",
    )
    star = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pairs = star.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a"
    )
    links = components(pairs.mapInArrow(_linker(share), "a long, b long"), "a", "b")
    links = settle(links, "links")

    placed = members.join(links, "node", "left").select(
        "key", "node", "n", F.coalesce("component", "node").alias("component")
    )
    placed = settle(placed, "placed")
    open_keys = (
        placed.groupBy("key")
        .agg(
            F.count("*").alias("texts"),
            F.sum("n").alias("shingles"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
            F.expr("bit_xor(xxhash64(node))").alias("who"),
        )
        .filter("least <> most and texts > 2")
        .groupBy("who", "texts", "shingles")  # bands that hold the same texts are compared once
        .agg(F.min("key").alias("key"))
        .withColumn("blocks", F.ceil(F.greatest(F.col("texts") / TILE_TEXTS, F.col("shingles") / TILE_SHINGLES)).cast("int"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = (
        placed.join(open_keys.select("key", "blocks"), "key")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "node", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(sets, "node")
    )
    more = settle(tiles.groupBy("key", "i", "j").applyInPandas(_tiler(share), "a long, b long").distinct(), "more")
    if more.head(1):
        known = links.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        links = components(known.unionByName(more), "a", "b")
    final = classes.join(links, "node", "left").select("mark", F.coalesce("component", "node").alias("component_id"))
    return _labelled(sketches, final)


def _labelled(sketches: DataFrame, final: DataFrame) -> DataFrame:
    linked = sketches.filter("doc_id is not null and n_shingles > 0").join(final, "mark")
    alone = sketches.filter("doc_id is null or n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    out = linked.select(columns).unionByName(alone.select(columns))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that with the smallest id, rows without an id last.

    A document is an id with a text. So rows that share an id but not a text are told apart, each with a number of its own
    behind all ids, and so are rows without an id; of rows equal in id and text one stays, the first in the order of the other
    columns. Texts without words are linked with nothing: those with an id stay one row an id, those without one stay all.
    Any column names go; extra columns stay with their rows.
    """
    id_, mark, node, at = (unused(docs.columns, c) for c in ("own_id", "own_mark", "own_node", "own_place"))
    rows = docs.withColumn(id_, F.col("doc_id").cast("long"))
    rows = rows.withColumn(mark, F.coalesce(F.md5(F.col("text").cast("string")), F.lit("")))
    unnamed = F.col(id_).isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = rows.filter(~unnamed).groupBy(id_).agg(F.min(mark).alias("least"), F.max(mark).alias("most"))
    unclear = texts.filter(F.col(id_).isNull() | (F.col("least") != F.col("most"))).select(F.col(id_).alias("id"))
    unclear = settle(unclear, "unclear")
    keyed = rows.filter(~unnamed)
    if unclear.isEmpty():
        keyed = keyed.withColumn(node, F.col(id_))
    else:
        told = keyed.select(F.col(id_).alias("_id"), F.col(mark).alias("_mark")).join(unclear, F.col("_id").eqNullSafe(F.col("id")), "left_semi")
        told = settle(told.distinct().withColumn("_number", F.monotonically_increasing_id()), "told")
        most = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()[0]
        if most > 2**62:
            raise ValueError("ids leave no room for rows that share an id or have none")
        keyed = keyed.join(told, F.col(id_).eqNullSafe(F.col("_id")) & (F.col(mark) == F.col("_mark")), "left")
        keyed = keyed.withColumn(node, F.coalesce(F.col("_number") + (max(most, 0) + 1), F.col(id_))).drop("_id", "_mark", "_number")
    kept = near_duplicates(keyed, size, share, doc_id=node).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text") and not isinstance(docs.schema[c].dataType, MapType)]
    first = Window.partitionBy(node).orderBy(*others or [F.lit(0)])
    named = keyed.join(kept, F.col(node) == F.col("_kept"), "left_semi").withColumn(at, F.row_number().over(first)).filter(F.col(at) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.select(*columns).unionByName(rows.filter(unnamed).select(*columns))
