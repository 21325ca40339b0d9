"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from seriesframe.llm.sharing import unused
from seriesframe.sources.files import settle

#: Rows of one running sum; larger sources get more chunks.
CHUNK_ROWS = 4_000
WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, order: list) -> DataFrame:
    """Adds ``place`` (from 0) in a global order without bringing all rows to one task: a range sort is written
    once, rows count inside their part, and the parts' sizes (one row each) give the offsets."""
    parts = settle(
        df.orderBy(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("inside", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))),
        "ordered",
    )
    sizes = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return parts.join(before, "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def filled_level(sources: DataFrame, budget: float) -> float:
    """Level L with sum of least(L * weight, cap) = budget: capped sources leave their excess to the others by weight.

    Each round is one aggregate over the sources that returns two numbers; capped sources stay capped.
    """
    level = 0.0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight") if level else F.col("cap") <= 0
        capped, free = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        now = (budget - capped) / free if free else level
        if now <= level:
            return level
        level = now


def fair_queue(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``start``, ``finish``,
    ``taken`` and the columns named in ``carry``, globally range-sorted by ``finish``.

    ``size`` counts the words of the whole text (null: 0). Sources in code point order, null last, get ``weights`` in
    turn and share ``share`` times all words; a source's target stops at ``most`` times its words, and the excess goes
    to the others by weight. Documents queue in the order of a seeded hash of their id, and the queue repeats
    ``most`` times. A document's virtual finish time is its source's cumulated words divided by the target. At
    virtual time 1 the words served add up to the budget: there the mix is truncated, and the document in service
    is cut at a word. ``taken`` counts the words served, repeats included, so each source is within a word of its target.

    Order, ties (id, size, checksum) and sums are functions of the rows, so reruns agree; rows equal in all of these
    are interchangeable. A source of any size is summed in chunks of the hash range, joined by one row per chunk.
    Documents without words, and all rows if there are no words at all, take nothing. An empty table gives no rows.
    """
    sized = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.crc32(F.encode("text", "utf-8")).alias("crc"),
            F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 16).alias("turn"),
            *carry,
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = numbered(sources, [F.asc_nulls_last("source")])
    choices = F.array(*[F.lit(float(w)) for w in weights])
    sources = settle(
        sources.withColumn("weight", F.element_at(choices, (F.col("place") % len(weights) + 1).cast("int"))).withColumn(
            "cap", F.col("source_size").cast("double") * most
        ),
        "sources",
    )
    total, rows = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    level = filled_level(sources, share * total)
    digits = max(1, math.ceil(math.log(max(rows, 1) / CHUNK_ROWS, 16)))
    sources = sources.select(
        F.col("source").alias("own_source"), "place", "source_size", F.least(F.lit(level) * F.col("weight"), "cap").alias("target")
    )
    queued = sized.join(sources, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")
    queued = queued.withColumn("chunk", F.substring("turn", 1, digits))
    chunks = queued.groupBy("place", "chunk").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("place").orderBy("chunk")) - F.col("words")
    chunks = chunks.select("place", "chunk", ahead.alias("ahead"))
    inside = Window.partitionBy("place", "chunk").orderBy("turn", F.asc_nulls_first("doc_id"), "size", "crc")
    start = F.col("ahead") + F.col("upto") - F.col("size")
    served = sum(
        F.greatest(F.lit(0), F.least("size", F.floor("target") - F.col("start") - F.col("source_size") * k)) for k in range(most)
    )
    return (
        queued.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(chunks, ["place", "chunk"])
        .withColumn("start", start)
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")))
        .withColumn("taken", served.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "start", "finish", "taken", *carry)
        .orderBy(F.asc_nulls_last("finish"), "doc_id")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every document once for each pass that serves it.

    A document that the budget cuts is kept whole in that pass, so no text is shortened here; ``fair_queue`` tells how
    many of its words count.
    """
    columns = docs.columns
    numbers = {c: unused(columns, f"carried_{k}") for k, c in enumerate(columns)}
    carried = docs.select("*", *[F.col(f"`{c}`").alias(n) for c, n in numbers.items()])
    queue = fair_queue(carried, carry=tuple(numbers.values()), **settings)
    passes = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return (
        queue.filter("taken > 0")
        .withColumn("times", F.explode(F.sequence(F.lit(1), passes)))
        .select(*[F.col(n).alias(c) for c, n in numbers.items()])
    )
