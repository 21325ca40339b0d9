"""Missing-value and rounding rules that differ from Spark's defaults.

Survey scripts expect strict aggregates (one missing input makes the result missing), casts
that yield null instead of failing, and missing keys that match each other. Every helper is a
built-in column expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def as_col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict(aggregate, x: str | Column) -> Column:
    """``aggregate(x)``, but null when any input is null."""
    c = as_col(x)
    return F.when(F.count(F.lit(1)) == F.count(c), aggregate(c))


def aggregate(fn, x: str | Column, na_rm: bool = True) -> Column:
    """Null-skipping (``na_rm``) or null-propagating form of one aggregate."""
    return fn(as_col(x)) if na_rm else strict(fn, x)


def n_distinct(*xs: str | Column, count_null: bool = False) -> Column:
    """Distinct count; with ``count_null`` a missing value counts as one more value."""
    cols = [as_col(x) for x in xs]
    n = F.countDistinct(*cols)
    if not count_null:
        return n
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return n + F.coalesce(F.max(missing.cast("int")), F.lit(0))


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """Division that gives null for a zero or missing divisor."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def lenient_cast(x: str | Column, to: str) -> Column:
    """Cast that gives null for text that does not parse."""
    return as_col(x).try_cast(to)


def fill_from(x: str | Column, *others) -> Column:
    """First non-null of the column and its fallbacks (columns or plain values)."""
    return F.coalesce(as_col(x), *[o if isinstance(o, Column) else F.lit(o) for o in others])


def blank_to_null(x: str | Column, sentinels: list[str]) -> Column:
    """Null for every value in ``sentinels``; other values pass through."""
    c = as_col(x)
    return F.when(~c.isin(sentinels), c)


def reject(x: str | Column, sentinels: list[str]) -> Column:
    """Predicate keeping rows whose value is present and is no sentinel."""
    return ~as_col(x).isin(sentinels)


def round_even(x: str | Column, digits: int = 0) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(as_col(x), digits)


def nulls_last(x: str | Column, descending: bool = False) -> Column:
    c = as_col(x)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def collapse(x: str | Column, groups: dict[str, list[str]]) -> Column:
    """Map several labels onto one; labels named in no group stay as they are."""
    c = as_col(x)
    for target, labels in groups.items():
        c = F.when(as_col(x).isin(labels), F.lit(target)).otherwise(c)
    return c


def presence(x: str | Column) -> Column:
    """1 where the count is positive, 0 where it is zero, null where it is missing."""
    return (as_col(x) > 0).cast("int")
