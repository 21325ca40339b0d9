"""Joins and set operations.

Joins whose one side may hold many rows of one key are written as inner and anti joins:
adaptive execution can split a hot key on either side of an inner join, but never the
right side of a left join or any side of a full join.

It does not split either when a later grouping relies on the join's partitioning. Null-safe
keys are derived expressions, on which no grouping by the plain columns can rely; use them, or
aggregate first, before grouping by a key that was just joined on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.functions.times import trunc_to
from seriesframe.sources.spines import expand_slots, id_range


def key_equal(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]], null_safe: bool = False) -> Column:
    terms = [a[x].eqNullSafe(b[y]) if null_safe else a[x] == b[y] for x, y in pairs]
    return reduce(lambda p, q: p & q, terms)


def _right_only(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``b`` with its keys renamed and columns that ``a`` has already left out."""
    extra = [c for c in b.columns if c not in on and c not in a.columns]
    return b.select(*[F.col(k).alias(f"_r_{k}") for k in on], *extra)


def join_keep_left(
    a: DataFrame, b: DataFrame, on: list[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Equi join that keeps the left copy of every shared column.

    Use it where ``b`` has few rows per key (a dimension, or an aggregate by ``on``).
    """
    right = _right_only(a, b, on)
    joined = a.join(right, key_equal(a, right, [(k, f"_r_{k}") for k in on], null_safe), how)
    return joined.drop(*[f"_r_{k}" for k in on])


def join_fan_out(a: DataFrame, b: DataFrame, on: list[str], null_safe: bool = False) -> DataFrame:
    """Left join of ``a`` to many rows of ``b`` per key, safe for hot keys of ``b``."""
    matched = join_keep_left(a, b, on, "inner", null_safe)
    alone = not_in(a, b, on, null_safe)
    return matched.unionByName(alone, allowMissingColumns=True)


def not_in(a: DataFrame, b: DataFrame, on: list[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``a`` whose key is absent in ``b``."""
    keys = b.select(*[F.col(k).alias(f"_r_{k}") for k in on]).distinct()
    return a.join(keys, key_equal(a, keys, [(k, f"_r_{k}") for k in on], null_safe), "left_anti")


def join_full(a: DataFrame, b: DataFrame, on: list[str], null_safe: bool = True) -> DataFrame:
    """Full outer join on many keys, missing keys matching each other by default."""
    both = join_keep_left(a, b, on, "inner", null_safe)
    left = not_in(a, b, on, null_safe)
    right = not_in(b, a, on, null_safe).select(*on, *[c for c in b.columns if c not in on and c not in a.columns])
    return both.unionByName(left, allowMissingColumns=True).unionByName(right, allowMissingColumns=True)


def join_full_many(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Fold of full joins over several tables with one row per key each."""
    return reduce(lambda a, b: join_full(a, b, on), tables)


def join_on_slot(a: DataFrame, b: DataFrame, ts: str, unit: str, name: str = "slot") -> DataFrame:
    """Inner join of two tables whose timestamps share a calendar unit (minute, hour or day)."""
    step_s = {"minute": 60, "hour": 3600, "day": 86400}[unit]
    slot = lambda df: df.withColumn(name, trunc_to(ts, step_s)).drop(ts)
    return join_keep_left(slot(a), slot(b), [name], "inner")


def stack(tables: list[DataFrame], dedupe: bool = True) -> DataFrame:
    """Stack tables by column name; rows equal in every column collapse to one."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.distinct() if dedupe else out


def attach(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Add per-group values to every row.

    ``stats`` has one row per group, so a hot group is a hot key on the left side only,
    which adaptive execution splits. A window over the group would put it into one task.
    """
    if not by:
        extra = [c for c in stats.columns if c not in df.columns]
        whole = stats.select(F.struct(*extra).alias("_s")).scalar()
        return df.withColumn("_s", whole).select(*df.columns, *[F.col("_s")[c].alias(c) for c in extra])
    return join_keep_left(df, stats, by, "left", null_safe=True)


def missing_ids(df: DataFrame, id_col: str, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Whole numbers absent from ``id_col`` between the bounds (default: its own range)."""
    if bounds:
        every = id_range(df.sparkSession, *bounds, name=id_col)
    else:
        ends = df.agg(F.min(id_col).cast("long").alias("_lo"), F.max(id_col).cast("long").alias("_hi"))
        every = expand_slots(ends, "_lo", "_hi", id_col)
    return not_in(every, df, [id_col])
