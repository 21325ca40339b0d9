"""Joins on the nearest time or number, and within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from seriesframe.functions.semantics import nulls_last
from seriesframe.functions.times import epoch_micros
from seriesframe.operators.relate import key_equal
from seriesframe.operators.scan import chunk_key, join_carry, range_chunks
from seriesframe.operators.summarise import repeat_rows

MICRO = 1_000_000


def _measure(df: DataFrame, on: str) -> tuple[Column, int]:
    """A number in which distances are exact, and how many of its steps are one second (or one unit)."""
    kind = df.schema[on].dataType
    if isinstance(kind, (TimestampNTZType, TimestampType, DateType)):
        return epoch_micros(F.col(on).cast("timestamp_ntz")), MICRO
    return F.col(on), 1


def join_nearest(
    a: DataFrame,
    b: DataFrame,
    on: str,
    by: list[str],
    tolerance: float | None = None,
    order: list[str] | None = None,
    how: str = "left",
    parts: int | None = None,
) -> DataFrame:
    """Each row of ``a`` with the row of ``b`` that is nearest in ``on`` among those with equal ``by``.

    ``on`` is a time (distances in seconds) or a number. Of two rows equally far the earlier one counts, of rows of ``b`` with
    the same ``by`` and ``on`` the first one in ``order`` (by default all their other columns). Nothing farther than ``tolerance``
    matches. Columns: those of ``a``, ``<on>_matched``, ``distance`` and what ``b`` has besides; ``how`` "inner" drops rows
    without a match. A missing ``on`` matches nothing, missing ``by`` match each other.

    Both sides become one stream in the order of ``by`` and ``on``, cut into ranges. Inside a range the last row of ``b`` before and
    the first one after each row are running values; one row a range carries them over its borders. A row of ``a`` meets
    two rows of ``b``, however many share its key, and neither a hot key nor copies of a row are a single task.
    """
    measure, unit = _measure(a, on)
    extra = [c for c in b.columns if c not in a.columns]
    ordered = order or [c for c in b.columns if c not in (*by, on)] or [on]
    first = Window.partitionBy(*by, on).orderBy(*[nulls_last(c) for c in ordered])
    # Of many equal places one row is kept, already before the shuffle.
    right = b.where(F.col(on).isNotNull()).withColumn("_place", F.row_number().over(first)).where("_place = 1")
    left = a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_copies"))
    hit = F.struct(_measure(b, on)[0].alias("at"), F.col(on).alias("on"), F.struct(*extra, F.lit(0).alias("_one")).alias("more"))
    rows = left.select(*by, measure.alias("_at"), F.lit(1).alias("_side"), F.struct(*a.columns, "_copies").alias("_row"))
    rows = rows.unionByName(right.select(*by, _measure(b, on)[0].alias("_at"), F.lit(0).alias("_side"), hit.alias("_hit")), allowMissingColumns=True)
    cut = range_chunks(rows, [*by, "_at", "_side", "_row"], parts).withColumn("_key", chunk_key(by))
    upto = (Window.unboundedPreceding, 0)
    back = Window.partitionBy("_key").orderBy("_at", "_side").rowsBetween(*upto)
    # Rows of b at the very place of a row of a stand before it, so those ahead are later ones.
    ahead = Window.partitionBy("_key").orderBy(F.col("_at").desc(), F.col("_side").desc()).rowsBetween(*upto)
    local = cut.withColumns({"_before": F.last("_hit", True).over(back), "_after": F.last("_hit", True).over(ahead)})
    place = F.when(F.col("_side") == 0, F.col("_at"))
    edges = cut.groupBy("_key").agg(F.min_by("_hit", place).alias("_first"), F.max_by("_hit", place).alias("_last"))
    names, chunk = [F.col("_key")[c] for c in by], F.col("_key")["_chunk"]
    earlier = Window.partitionBy(*names).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*names).orderBy(chunk.desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select("_key", F.last("_last", True).over(earlier).alias("_cb"), F.last("_first", True).over(later).alias("_ca"))
    met = join_carry(local.where("_side = 1"), carry)
    before, after = F.coalesce("_before", "_cb"), F.coalesce("_after", "_ca")
    met = met.select("_row", "_at", before.alias("_before"), after.alias("_after"))
    to_before, to_after = F.col("_at") - F.col("_before.at"), F.col("_after.at") - F.col("_at")
    pick = F.when(to_after.isNull() | (to_before <= to_after), F.col("_before")).otherwise(F.col("_after"))
    met = met.withColumns({"_pick": pick, "_off": F.least(to_before, to_after)})
    if tolerance is not None:
        near = F.col("_off") <= tolerance * unit
        met = met.withColumns({"_pick": F.when(near, F.col("_pick")), "_off": F.when(near, F.col("_off"))})
    fine = F.col("_off").isNotNull()
    met = met.where(fine) if how == "inner" else met
    out = repeat_rows(met.select("_row.*", F.when(fine, F.col("_pick")).alias("_pick"), "_off"), "_copies", "_copy")
    distance = F.col("_off") / F.lit(unit) if unit > 1 else F.col("_off")
    return out.select(
        *a.columns, F.col("_pick.on").alias(f"{on}_matched"), distance.alias("distance"), *[F.col(f"_pick.more.`{c}`").alias(c) for c in extra]
    )


def join_within(a: DataFrame, b: DataFrame, on: tuple[str, str], tolerance: float, by: list[str] | None = None) -> DataFrame:
    """All pairs of rows whose numbers differ by at most ``tolerance``, with equal ``by``; ``distance`` is a's number less b's.

    Numbers fall into buckets as wide as the tolerance; rows of ``b`` stand in their own bucket and both neighbours, so
    the join is an equality on the bucket, which hot buckets share out like any hot key. Shared columns keep a's copy. Missing numbers
    and keys match nothing.
    """
    by = by or []
    if not tolerance > 0:
        raise ValueError("the tolerance must be positive; join on equality otherwise")
    x, y = on
    bucket = lambda c: F.floor(F.col(c).cast("double") / tolerance)
    fine = lambda c: F.abs(F.col(c).cast("double") / tolerance) < 2.0**52  # a bucket beyond holds one number at most
    extra = [c for c in b.columns if c not in a.columns and c != y]
    right = b.where(fine(y)).select(*[F.col(k).alias(f"_r_{k}") for k in by], F.col(y).alias("_y"), *extra)
    right = right.withColumn("_bucket_b", F.explode(F.sequence(bucket("_y") - 1, bucket("_y") + 1)))
    left = a.where(fine(x)).withColumn("_bucket", bucket(x))
    pairs = [("_bucket", "_bucket_b"), *[(k, f"_r_{k}") for k in by]]
    met = left.join(right, key_equal(left, right, pairs)).withColumn("distance", F.col(x) - F.col("_y"))
    name = [] if y in a.columns else [F.col("_y").alias(y)]
    return met.where(F.abs("distance") <= tolerance).select(*a.columns, *name, *extra, "distance")
