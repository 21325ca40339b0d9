"""Cleaning: rename, lenient casts, sentinels, corrections, simple row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.functions.semantics import blank_to_null, lenient_cast
from seriesframe.operators.relate import join_keep_left, key_equal


def clean(
    df: DataFrame,
    renames: dict[str, str] | None = None,
    casts: dict[str, str] | None = None,
    sentinels: list[str] | None = None,
    relabel: dict[str, dict[str, str]] | None = None,
    absolute: list[str] | None = None,
    drop: list[str] | None = None,
) -> DataFrame:
    """One projection: rename, relabel, null out sentinels, cast leniently, flip signs, drop.

    ``renames`` maps old to new names; the other arguments use the new names. Sentinels are nulled in
    every column that is cast and in every text column.
    """
    out = df.withColumnsRenamed(renames or {})
    if drop:
        out = out.drop(*drop)
    casts, relabel, absolute = casts or {}, relabel or {}, absolute or []
    cols = {}
    texts = [c for c, t in out.dtypes if t == "string"] if sentinels else []
    for name in dict.fromkeys([*relabel, *casts, *absolute, *texts]):
        c = F.col(name)
        for old, new in relabel.get(name, {}).items():
            c = F.when(F.col(name) == old, F.lit(new)).otherwise(c)
        if sentinels and (name in casts or name in texts):
            c = blank_to_null(c, sentinels)
        if name in casts:
            c = lenient_cast(c, casts[name])
        if name in absolute:
            c = F.abs(c)
        cols[name] = c
    return out.withColumns(cols) if cols else out


def pick(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by 1-based position, resolved to names at once; negative positions drop."""
    if positions and all(p < 0 for p in positions):
        out = {-p - 1 for p in positions}
        return df.select([c for i, c in enumerate(df.columns) if i not in out])
    return df.select([df.columns[p - 1] for p in positions])


def lookup(df: DataFrame, table: dict[tuple, float], on: list[str], value: str, default=None) -> DataFrame:
    """Add ``value`` from a fixed table keyed by ``on``; keys without an entry get ``default``.

    The table is program text, so its size is fixed and it is broadcast.
    """
    types = dict(df.dtypes)

    def row(key, v):
        parts = key if isinstance(key, tuple) else (key,)
        keys = [F.lit(p).cast(types[c]).alias(f"_k{i}") for i, (p, c) in enumerate(zip(parts, on))]
        return F.struct(*keys, F.lit(float(v)).alias(value))

    entries = F.array(*[row(k, v) for k, v in table.items()])
    small = F.broadcast(df.sparkSession.range(1).select(F.inline(entries)))
    match = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(on)]
    out = df.join(small, match, "left").drop(*[f"_k{i}" for i in range(len(on))])
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(float(default))))


def apply_corrections(
    df: DataFrame, fixes: DataFrame | None, key: list[str], deletes: DataFrame | None = None
) -> DataFrame:
    """Overwrite single cells and delete rows, both addressed by key.

    ``fixes`` holds the key plus replacement columns; a null replacement leaves the cell alone.
    """
    out = df
    if deletes is not None:
        out = out.join(deletes.select(*key).distinct(), key, "left_anti")
    if fixes is not None:
        changed = [c for c in fixes.columns if c not in key]
        renamed = fixes.withColumnsRenamed({c: f"_fix_{c}" for c in changed})
        out = join_keep_left(out, renamed, key).withColumns(
            {c: F.coalesce(F.col(f"_fix_{c}"), F.col(c)) for c in changed}
        )
        out = out.drop(*[f"_fix_{c}" for c in changed])
    return out


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns (default: all)."""
    return df.dropna("any", subset=cols)


def keep_members(df: DataFrame, col: str, members: list | DataFrame) -> DataFrame:
    """Rows whose ``col`` is in a short list, or in the first column of a table."""
    if isinstance(members, DataFrame):
        wanted = members.select(F.col(members.columns[0]).alias("_member")).distinct()
        return df.join(wanted, key_equal(df, wanted, [(col, "_member")]), "left_semi")
    return df.where(F.col(col).isin(members))


def time_range(df: DataFrame, ts: str, lo: str | Column, hi: str | Column, closed: bool = True) -> DataFrame:
    """Rows inside a time range, ends included or not; the predicate reaches the scan."""
    low = F.lit(lo).cast("timestamp_ntz") if isinstance(lo, str) else lo
    high = F.lit(hi).cast("timestamp_ntz") if isinstance(hi, str) else hi
    c = F.col(ts)
    return df.where((c >= low) & (c <= high) if closed else (c > low) & (c < high))


def calendar_subset(df: DataFrame, date: str, start: str, end: str, days: list[int]) -> DataFrame:
    """Rows between two dates (ends included) on the listed days of the month."""
    d = F.col(date)
    return df.where(
        (d >= F.lit(start).cast("date")) & (d <= F.lit(end).cast("date")) & F.dayofmonth(d).isin(days)
    )
