"""Registered queries: each operator on the test tables, with the same statement as plain SQL."""

from seriesframe.catalog import cleaning, dynamics, fits, models, multiple, nearby, pipelines, relations, series, significance, summaries, windows

_MODULES = (cleaning, relations, summaries, windows, series, dynamics, models, fits, significance, multiple, nearby, pipelines)


def all_queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
