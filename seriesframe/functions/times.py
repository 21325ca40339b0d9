"""Date and time columns.

Timestamps here carry no zone (``timestamp_ntz``). The epoch helpers work on the wall-clock
fields themselves, so results do not depend on the session time zone or on daylight saving.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seriesframe.functions.semantics import as_col

DAY_S = 86400


def epoch_seconds(ts: str | Column) -> Column:
    """Whole wall-clock seconds since 1970-01-01 00:00."""
    c = as_col(ts)
    return (
        F.unix_date(F.to_date(c)).cast("long") * DAY_S
        + F.hour(c) * 3600
        + F.minute(c) * 60
        + F.second(c)
    )


def epoch_micros(ts: str | Column) -> Column:
    c = as_col(ts)
    fraction = (F.date_part(F.lit("SECOND"), c) * 1000000).cast("long") % 1000000
    return epoch_seconds(c) * 1000000 + fraction


def add_seconds(ts: str | Column, seconds: str | Column) -> Column:
    zero = F.lit(0)
    return as_col(ts) + F.make_dt_interval(zero, zero, zero, as_col(seconds).cast("decimal(18,6)"))


def from_epoch_seconds(seconds: str | Column) -> Column:
    return add_seconds(F.lit("1970-01-01").cast("timestamp_ntz"), seconds)


def from_epoch_micros(micros: str | Column) -> Column:
    return add_seconds(
        F.lit("1970-01-01").cast("timestamp_ntz"), as_col(micros).cast("decimal(20,0)") / 1000000
    )


def slot_of(ts: str | Column, step_s: int) -> Column:
    """Number of the ``step_s`` slot a timestamp falls into, counted from the epoch."""
    return F.floor(epoch_seconds(ts) / F.lit(step_s)).cast("long")


def slot_start(slot: str | Column, step_s: int) -> Column:
    return from_epoch_seconds(as_col(slot) * step_s)


def trunc_to(ts: str | Column, step_s: int) -> Column:
    """Start of the ``step_s`` slot of a timestamp; no zone and no daylight saving enters."""
    return slot_start(slot_of(ts, step_s), step_s)


def round_to(ts: str | Column, step_s: int) -> Column:
    """Nearest multiple of ``step_s``, halves up; fractions of a second count."""
    micros = step_s * 1000000
    nearest = F.floor((epoch_micros(ts) + micros // 2) / F.lit(micros)).cast("long")
    return from_epoch_seconds(nearest * step_s)


def clock_text(ts: str | Column) -> Column:
    return F.date_format(as_col(ts), "HH:mm:ss")


def julian_days(ts: str | Column, origin: str) -> Column:
    """Fractional days since ``origin`` (``yyyy-MM-dd``)."""
    start = F.unix_date(F.lit(origin).cast("date")).cast("long") * DAY_S * 1000000
    return (epoch_micros(ts) - start) / F.lit(86400000000.0)


def week_of_year(d: str | Column) -> Column:
    """Weeks counted in sevens from 1 January (not ISO weeks)."""
    return (F.floor((F.dayofyear(as_col(d)) - 1) / 7) + 1).cast("int")


def parse_hhmm(day: str | Column, hhmm: str | Column) -> Column:
    """Timestamp from a date and an ``HHMM`` number without leading zeros (607 is 06:07).

    Numbers that are no clock time give null.
    """
    t = as_col(hhmm).cast("long")
    hours, minutes = F.floor(t / 100).cast("long"), t % 100
    valid = (hours >= 0) & (hours < 24) & (minutes < 60)
    return F.when(valid, add_seconds(as_col(day).cast("timestamp_ntz"), hours * 3600 + minutes * 60))


def runtime_seconds(text: str | Column) -> Column:
    """Seconds of an ``H:MM`` duration; hours above zero count too, other text gives null."""
    c = as_col(text)
    part = lambda i: F.regexp_extract(c, r"^\s*(\d+):(\d{1,2})\s*$", i).try_cast("long")
    return part(1) * 3600 + part(2) * 60


def parse_date(text: str | Column, fmt: str) -> Column:
    """Date by pattern; text that does not match gives null."""
    return F.try_to_timestamp(as_col(text), F.lit(fmt)).cast("date")
