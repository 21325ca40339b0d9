"""Ordered operators over series of any length.

A window over a whole series is one task. Here a series is cut into chunks that follow its
order. Windows run inside a chunk, one small row per chunk carries what later (or earlier)
chunks need to know, and the carried values join back on (series, chunk).

Two ways to cut:

* ``slot_chunk``: series on a regular grid have one row per slot, so ``size`` slots are at
  most ``size`` rows. The chunk is an expression of the slot and costs no extra shuffle.
* ``range_chunks``: rows in any order, ties and hot groups included. Spark range-partitions by
  the full sort key, so chunks are balanced whatever the groups look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesframe.sources.files import settle

CHUNK = 4096


def slot_chunk(slot: str, size: int = CHUNK) -> Column:
    return F.floor(F.col(slot) / size)


def range_chunks(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Add ``_chunk``: the range partition of each row under ``order``.

    The partition borders come from a sample, so the numbered rows are written out: every
    later use, and every recomputation after a lost executor, sees the same chunks.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return settle(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")


def chunk_key(by: list[str]) -> Column:
    """Series and chunk as one struct: windows, aggregates and joins share one partitioning.

    Equality of structs also matches missing series names with each other.
    """
    return F.struct(*by, "_chunk")


def join_carry(local: DataFrame, carry: DataFrame) -> DataFrame:
    """Bring the carried values to the rows of their chunk; the rows are not shuffled again."""
    return local.join(carry.withColumnRenamed("_key", "_ck"), F.col("_key") == F.col("_ck"), "left").drop("_ck")


def nearest_observed(df: DataFrame, by: list[str], slot: str, value: str, size: int = CHUNK) -> DataFrame:
    """Add the last observation at or before each slot and the first at or after it.

    New columns: ``prev_slot``, ``prev_value``, ``next_slot``, ``next_value``.
    """
    seen = F.when(F.col(value).isNotNull(), F.col(slot))
    rows = df.withColumns({"_chunk": slot_chunk(slot, size), "_seen": seen}).withColumn("_key", chunk_key(by))
    # Two running frames, one per direction: a frame that ends at the series end would be
    # evaluated anew for every row.
    upto = (Window.unboundedPreceding, 0)
    back = Window.partitionBy("_key").orderBy(slot).rowsBetween(*upto)
    ahead = Window.partitionBy("_key").orderBy(F.col(slot).desc()).rowsBetween(*upto)
    local = rows.withColumns(
        {
            "_ps": F.last("_seen", True).over(back),
            "_pv": F.last(value, True).over(back),
            "_ns": F.last("_seen", True).over(ahead),
            "_nv": F.last(value, True).over(ahead),
        }
    )
    edges = rows.groupBy("_key").agg(
        F.min("_seen").alias("_first_s"),
        F.min_by(value, "_seen").alias("_first_v"),
        F.max("_seen").alias("_last_s"),
        F.max_by(value, "_seen").alias("_last_v"),
    )
    names = [F.col("_key")[c] for c in by]
    chunk = F.col("_key")["_chunk"]
    before = Window.partitionBy(*names).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*names).orderBy(chunk.desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        "_key",
        F.last("_last_s", True).over(before).alias("_cps"),
        F.last("_last_v", True).over(before).alias("_cpv"),
        F.last("_first_s", True).over(after).alias("_cns"),
        F.last("_first_v", True).over(after).alias("_cnv"),
    )
    return join_carry(local, carry).select(
        *df.columns,
        F.coalesce("_ps", "_cps").alias("prev_slot"),
        F.coalesce("_pv", "_cpv").alias("prev_value"),
        F.coalesce("_ns", "_cns").alias("next_slot"),
        F.coalesce("_nv", "_cnv").alias("next_value"),
    )


def fill_down(
    df: DataFrame, by: list[str], slot: str, cols: list[str], size: int = CHUNK, seen: DataFrame | None = None
) -> DataFrame:
    """Carry the last value of each column forward inside its group.

    ``seen`` may hold the rows of ``df`` that have values, the first and last of each group among them: then ``df``
    itself, with its empty slots, is worked out once only.
    """
    rows = df.withColumn("_chunk", slot_chunk(slot, size)).withColumn("_key", chunk_key(by))
    back = Window.partitionBy("_key").orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_l_{c}": F.last(c, True).over(back) for c in cols})
    held = rows
    if seen is not None:
        # Chunks without values have an end, too: that of the chunk before them.
        bounds = seen.groupBy(*by).agg(F.min(slot).alias("_lo"), F.max(slot).alias("_hi"))
        chunks = F.explode(F.sequence(slot_chunk("_lo", size), slot_chunk("_hi", size)))
        every = bounds.withColumn("_chunk", chunks).withColumn("_key", chunk_key(by)).select("_key")
        held = seen.withColumn("_chunk", slot_chunk(slot, size)).withColumn("_key", chunk_key(by)).unionByName(every, allowMissingColumns=True)
    ends = held.groupBy("_key").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(slot))).alias(f"_e_{c}") for c in cols]
    )
    series = Window.partitionBy(*[F.col("_key")[c] for c in by]).orderBy(F.col("_key")["_chunk"])
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_key", *[F.last(f"_e_{c}", True).over(before).alias(f"_c_{c}") for c in cols])
    return join_carry(local, carry).select(
        *[F.coalesce(f"_l_{c}", f"_c_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def with_halo(df: DataFrame, slot: str, reach: int, size: int = CHUNK) -> DataFrame:
    """Copy rows near a chunk border into the neighbouring chunks as well.

    ``_chunk`` is the chunk to compute in and ``_home`` tells the one copy to keep. A window of
    ``reach`` slots to each side is then complete inside a chunk; with ``size`` above
    2 * ``reach`` a row is copied at most once.
    """
    size = max(size, 2 * reach + 1)
    low = F.floor((F.col(slot) - reach) / size)
    high = F.floor((F.col(slot) + reach) / size)
    copies = df.withColumn("_chunk", F.explode(F.sequence(low, high)))
    return copies.withColumn("_home", F.col("_chunk") == slot_chunk(slot, size))


def running_sums(chunked: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Running sums of several columns per group, for rows cut by ``range_chunks``."""
    parts = list(enumerate(values.values()))
    rows = chunked.withColumns({**{f"_f{k}": v for k, v in parts}, "_key": chunk_key(by)})
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_l{k}": F.sum(f"_f{k}").over(inside) for k, _ in parts})
    sums = rows.groupBy("_key").agg(*[F.sum(f"_f{k}").alias(f"_t{k}") for k, _ in parts])
    series = Window.partitionBy(*[F.col("_key")[c] for c in by]).orderBy(F.col("_key")["_chunk"])
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_key", *[F.sum(f"_t{k}").over(before).alias(f"_c{k}") for k, _ in parts])
    total = lambda k: F.col(f"_l{k}") + F.coalesce(F.col(f"_c{k}"), F.lit(0))
    kept = [c for c in chunked.columns if c not in values]
    return join_carry(local, carry).select(*kept, *[total(k).alias(n) for k, n in enumerate(values)])


def running_count(chunked: DataFrame, by: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """Running number of rows with ``flag`` per group, for rows cut by ``range_chunks``."""
    return running_sums(chunked, by, order, {name: flag.cast("long")})
