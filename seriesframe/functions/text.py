"""Key building and string reshaping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seriesframe.functions.semantics import as_col


def make_key(*parts: str | Column, sep: str = "-", missing: str = "NA") -> Column:
    """Join the parts to one key; a missing part stays visible as the ``missing`` text."""
    return F.concat_ws(sep, *[F.coalesce(as_col(p).cast("string"), F.lit(missing)) for p in parts])


def compact_date(d: str | Column) -> Column:
    """Date as ``yyyymmdd`` text."""
    return F.date_format(as_col(d), "yyyyMMdd")


def unite(*parts: str | Column, sep: str = "_") -> Column:
    """Join columns with a separator; missing parts are left out."""
    return F.concat_ws(sep, *[as_col(p).cast("string") for p in parts])


def separate(x: str | Column, pattern: str, into: list[str]) -> list[Column]:
    """Split by a regular expression into named columns; pieces that are absent are null."""
    pieces = F.split(as_col(x), pattern)
    return [F.get(pieces, F.lit(i)).alias(name) for i, name in enumerate(into)]
