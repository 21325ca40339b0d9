"""Grouped summaries built from partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesframe.functions.semantics import nulls_last
from seriesframe.operators.relate import attach
from seriesframe.operators.scan import range_chunks, running_sums
from seriesframe.sources.files import settle


def summarise(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Group and aggregate; every aggregate is named by its keyword."""
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in aggs.items()])


def event_values(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per event from a table where events repeat once per specimen.

    Distinct hashes on every column, so an event with very many specimens is combined on the
    map side and never gathers in one task.
    """
    return df.select(*keys, *values).distinct()


def event_sum(df: DataFrame, event: str, value: str, by: list[str], name: str) -> DataFrame:
    """Sum of one value per event over ``by``, however often the join repeated the event."""
    return event_values(df, [*by, event], [value]).groupBy(*by).agg(F.sum(value).alias(name))


def share(df: DataFrame, value: str, within: list[str], name: str = "share") -> DataFrame:
    """Each row's part of its group total (whole table when ``within`` is empty)."""
    totals = df.groupBy(*within).agg(F.sum(value).alias("_total"))
    return attach(df, totals, within).withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def share_small(df: DataFrame, value: str, within: list[str], name: str = "share") -> DataFrame:
    """``share`` by a window, for tables aggregated to a few rows per group (one per category)."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(name, F.try_divide(F.col(value), total))


def repeated(df: DataFrame, key: list[str], name: str = "n") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


#: Copies of one row that a task writes at most.
COPIES = 10_000


def repeat_rows(df: DataFrame, times: str, name: str = "copy") -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 1; rows with very many copies are dealt to many tasks."""
    few = df.where(F.col(times) <= COPIES)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES)))
    many = df.where(F.col(times) > COPIES).withColumn("_block", blocks).repartition("_block", *df.columns)
    low, high = F.col("_block") * COPIES + 1, F.least((F.col("_block") + 1) * COPIES, F.col(times))
    few = few.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    many = many.withColumn(name, F.explode(F.sequence(low.cast("long"), high.cast("long")))).drop("_block")
    return few.unionByName(many)


#: Buckets that keys are dealt to, and rows of one bucket that a single task may sort.
BUCKETS = 16_384
LARGE = 1_000_000


def duplicate_flags(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Flags for repeats: ``dup_later`` (not the first of its key), ``dup_any`` (key repeats).

    Rows are numbered in the given order, missing values first, then by the other columns; of rows that are equal in all
    any one counts as the first. Missing keys form a key of their own. The rows of each bucket of keys are counted before,
    so ``df`` is worked out twice. A window over the key flags the rows of common buckets in one shuffle. Where buckets are
    large, the rows are written out with an id, and those of large buckets get the first id and the size of their key,
    which are combined on the map side, by a join. So neither a hot key nor copies of a row are a single task.
    """
    columns, types = df.columns, dict(df.dtypes)
    full = [*order, *[c for c in columns if c not in order]]
    # Texts that a collation holds equal have other hashes: such a column does not choose the bucket.
    bucket = F.pmod(F.xxhash64(F.lit(0), *[c for c in key if "collate" not in types[c]]), F.lit(BUCKETS))
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    large = [row["_bucket"] for row in sizes.where(F.col("_n") > LARGE).collect()]
    if large:
        df = settle(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    series = Window.partitionBy(*key).orderBy(*full)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later, repeats = F.row_number().over(series) > 1, F.count(F.lit(1)).over(whole) > 1
    flagged = df.where(~bucket.isin(large)).select(*columns, later.alias("dup_later"), repeats.alias("dup_any"))
    if large:
        hot = df.where(bucket.isin(large))
        first = F.min(F.struct(*full, "_row"))["_row"]
        known = attach(hot, hot.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first")), key)
        later, repeats = F.col("_row") != F.col("_first"), F.col("_n") > 1
        flagged = flagged.unionByName(known.select(*columns, later.alias("dup_later"), repeats.alias("dup_any")))
    return flagged


def rank_rows(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Rank of each row under ``value``, ties alike and counted (1, 1, 3), missing values first.

    Equal values are counted, the counts are cut into ranges and summed up in order, and the ranks join back: no
    window goes over the whole table.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sums(range_chunks(counts, [value]), [], [value], {"_upto": F.col("_n")})
    ranks = upto.select(value, (F.col("_upto") - F.col("_n") + 1).cast("long").alias(name))
    return attach(df, ranks, [value])


def keep_best(df: DataFrame, by: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """First row of each group under ``order`` (column, descending), missing values last.

    The rank filter becomes a group limit that already runs before the shuffle, so each map
    task sends at most one row of a group, hot or not.
    """
    w = Window.partitionBy(*by).orderBy(*[nulls_last(c, descending) for c, descending in order])
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") == 1).drop("_place")


def argmax_rows(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows holding their group's maximum, ties kept; limited before the shuffle like
    ``keep_best``."""
    w = Window.partitionBy(*by).orderBy(nulls_last(value, True))
    top = df.withColumn("_place", F.rank().over(w)).where(F.col("_place") == 1).drop("_place")
    return top.where(F.col(value).isNotNull())


def top_categories(df: DataFrame, category: str, value: str, k: int, above=None) -> DataFrame:
    """The ``k`` categories with the largest totals (ties by name), optionally above a floor."""
    totals = df.groupBy(category).agg(F.sum(value).alias("total"))
    if above is not None:
        totals = totals.where(F.col("total") > above)
    return totals.orderBy(nulls_last("total", True), nulls_last(category)).limit(k)


def slot_histogram(df: DataFrame, slot: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per slot and equal-width bin; values outside fall into bins 0 and ``bins`` + 1."""
    b = F.width_bucket(F.col(value), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin")
    return df.where(F.col(value).isNotNull()).groupBy(*slot, b).agg(F.count(F.lit(1)).alias("n"))


def category_order(df: DataFrame, order: list[str], category: str, name: str = "position") -> DataFrame:
    """Position of each category in a given order; unlisted categories come last."""
    c = F.lit(len(order) + 1)
    for i, label in reversed(list(enumerate(order, 1))):
        c = F.when(F.col(category) == label, F.lit(i)).otherwise(c)
    return df.withColumn(name, c)
