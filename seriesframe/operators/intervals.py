"""Repair of touching and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seriesframe.functions.times import epoch_micros, from_epoch_micros
from seriesframe.operators.scan import chunk_key, join_carry, range_chunks


def resolve_overlaps(
    df: DataFrame, start: str, end: str, by: list[str], tie: str, gap_s: int = 1, parts: int | None = None
) -> DataFrame:
    """Make the intervals of each unit disjoint; adds ``start_adj`` and ``end_adj``.

    In start order (ties by ``tie``), an interval that begins before the one before it has
    ended moves forward, keeping its length, to that end; the shift carries on down the
    line. Where two intervals then touch, the earlier ends and the later begins ``gap_s``
    seconds away from the shared instant. An interval shorter than two gaps takes the room of two
    gaps in line, so no end comes before its start and the results are disjoint.

    With running length C, the moved end is C + max(start - C before) over the rows so far:
    one running sum and one running maximum, both carried over chunk borders.
    """
    key, gap = [*by, "_s", tie], gap_s * 1000000
    base = df.withColumns({"_s": epoch_micros(start), "_e": epoch_micros(end)})
    rows = range_chunks(base, key, parts).withColumns(
        {
            "_own": F.greatest(F.col("_e") - F.col("_s"), F.lit(0)),
            "_len": F.greatest(F.col("_e") - F.col("_s"), F.lit(2 * gap)),
            "_key": chunk_key(by),
        }
    )
    inside = Window.partitionBy("_key").orderBy("_s", tie)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = rows.withColumn("_c0", F.coalesce(F.sum("_len").over(earlier), zero))
    local = local.withColumn("_lead", F.col("_s") - F.col("_c0"))
    local = local.withColumns(
        {
            "_m": F.max("_lead").over(so_far),
            "_m0": F.max("_lead").over(earlier),
            "_ls": F.lead("_s").over(inside),
        }
    )
    # The last row of a chunk knows the chunk's whole length and maximum.
    last = local.where(F.col("_ls").isNull()).select(
        "_key", (F.col("_c0") + F.col("_len")).alias("_tot"), F.col("_m").alias("_top")
    )
    first = rows.groupBy("_key").agg(F.min("_s").alias("_first"))
    chunks = Window.partitionBy(*[F.col("_key")[c] for c in by]).orderBy(F.col("_key")["_chunk"])
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = last.join(first, "_key")
    carry = carry.withColumn("_off", F.coalesce(F.sum("_tot").over(before), zero))
    carry = carry.withColumns(
        {
            "_ctop": F.max(F.col("_top") - F.col("_off")).over(before),
            "_cnext": F.lead("_first").over(chunks),
        }
    ).select("_key", "_off", "_ctop", "_cnext")
    out = join_carry(local, carry)
    top = F.greatest(F.col("_m") - F.col("_off"), F.col("_ctop"))
    top_before = F.greatest(F.col("_m0") - F.col("_off"), F.col("_ctop"))
    used = F.col("_c0") + F.col("_off")
    out = out.withColumns({"_end": used + F.col("_len") + top, "_end0": used + top_before})
    out = out.withColumn("_start", F.col("_end") - F.col("_len"))
    after_touch = F.coalesce(F.col("_s") <= F.col("_end0"), F.lit(False))
    before_touch = F.coalesce(F.coalesce("_ls", "_cnext") <= F.col("_end"), F.lit(False))
    begin = F.col("_start") + F.when(after_touch, gap).otherwise(0)
    return out.select(
        *df.columns,
        from_epoch_micros(begin).alias("start_adj"),
        from_epoch_micros(
            F.when(before_touch, F.col("_end") - gap).otherwise(F.greatest(begin, F.col("_start") + F.col("_own")))
        ).alias("end_adj"),
    )
