"""Bar intervals and calendar arithmetic."""

from __future__ import annotations

from datetime import datetime
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported bar intervals and their length in seconds.
STEP_SECONDS = {
    "1m": 60,
    "3m": 180,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "6h": 21600,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "3d": 259200,
    "1w": 604800,
}


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def step_of(interval: str) -> int:
    """Step in seconds of one interval name, checked while the plan is built."""
    try:
        return STEP_SECONDS[interval]
    except KeyError:
        raise ValueError(f"unsupported candle interval: {interval!r}") from None


def step_seconds(interval: Column | str, strict: bool = True) -> Column:
    """Step in seconds per row. Unknown intervals raise, or give NULL when not strict."""
    name = as_column(interval)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(STEP_SECONDS.items())])
    step = F.try_element_at(table, name)
    if strict:
        complaint = F.concat(F.lit("unsupported candle interval: "), F.coalesce(name, F.lit("null")))
        step = F.when(step.isNull(), F.raise_error(complaint).cast("int")).otherwise(step)
    return step.cast("long")


def plus_seconds(ts: Column | str, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(as_column(ts)) + seconds.cast("long") * 1_000_000)


def close_time(open_time: Column | str = "open_time", interval: Column | str = "interval") -> Column:
    """The instant the bar ends: open time plus one step."""
    return plus_seconds(open_time, step_seconds(interval))


def is_closed(now: Column | datetime, open_time="open_time", interval="interval") -> Column:
    """A bar is closed once its end is not after ``now``."""
    at = now if isinstance(now, Column) else F.lit(now)
    return close_time(open_time, interval) <= at


def is_aligned(open_time: Column | str = "open_time", interval: Column | str = "interval") -> Column:
    """Whether the bar opens on a multiple of its step counted from 1970-01-01.

    Weeks therefore start on Thursdays.
    """
    return F.unix_micros(as_column(open_time)) % (step_seconds(interval) * 1_000_000) == 0


def expected_slots(start: Column | str, end: Column | str, step: Column) -> Column:
    """Array of every slot from ``start`` to ``end``, both included; empty when end < start."""
    start, end = as_column(start), as_column(end)
    slots = F.transform(
        F.sequence(F.unix_micros(start), F.unix_micros(end), step * 1_000_000),
        lambda us: F.timestamp_micros(us),
    )
    return F.when(end >= start, slots).otherwise(F.array().cast("array<timestamp>"))


def month_slices(start: Column | str, end: Column | str) -> Column:
    """Array of ``struct(slice_start, slice_end)``: [start, end) cut at month borders."""
    start, end = as_column(start), as_column(end)
    months = F.sequence(
        F.date_trunc("month", start), F.date_trunc("month", end), F.expr("interval 1 month")
    )
    cut = F.transform(
        months,
        lambda m: F.struct(
            F.greatest(m, start).alias("slice_start"),
            F.least(m + F.expr("interval 1 month"), end).alias("slice_end"),
        ),
    )
    kept = F.filter(cut, lambda s: s["slice_start"] < s["slice_end"])
    empty = F.array().cast("array<struct<slice_start:timestamp,slice_end:timestamp>>")
    return F.when(start < end, kept).otherwise(empty)


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Days between two instants, fractions of a second dropped."""
    micros = F.unix_micros(as_column(end)) - F.unix_micros(as_column(start))
    return F.floor(micros / F.lit(1_000_000)) / F.lit(86_400.0)
