"""Bar quality: structural checks that quarantine, sequence checks that only flag.

Nothing is dropped silently: ``retained`` and ``quarantined`` together are the input. Sequence
checks follow *arrival* order, given by an explicit column, and see quarantined bars too.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import is_aligned, step_seconds
from tidemark.plans.ordered import POSITION, Measure, Series
from tidemark.session import scratch

EVENT_COLUMNS = ("instrument_id", "interval", "check_name", "severity", "open_time", "details")
ARRIVALS = Series(("instrument_id", "interval"), ("arrival",), width=1 << 14, segment_rows=None)
# Marks bars that only stand in front of a batch: they are context and have no events.
BEFORE = "_before"


def arrival_series(order_col: str, width: int = 1 << 14) -> Series:
    """Batches in the order of ``order_col`` (integer or timestamp)."""
    return Series(("instrument_id", "interval"), (order_col,), width=width, segment_rows=None)


# -- one bar at a time --------------------------------------------------------------------------


def _text(*columns: str) -> Column:
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.create_map(*pairs)


def with_violations(bars: DataFrame) -> DataFrame:
    """Add ``violations``: an array of (check_name, details), empty for a sound bar."""
    broken_shape = (
        (F.col("high") < F.greatest("open", "close"))
        | (F.col("low") > F.least("open", "close"))
        | (F.col("high") < F.col("low"))
    )
    checks = [
        ("ohlc_invariant", broken_shape, _text("open", "high", "low", "close")),
        ("volume_nonneg", F.col("volume") < 0, _text("volume")),
        ("timestamp_alignment", ~is_aligned(), _text("interval")),
    ]
    found = F.array(
        *[
            F.when(bad, F.struct(F.lit(name).alias("check_name"), details.alias("details")))
            for name, bad, details in checks
        ]
    )
    return bars.withColumn("violations", F.array_compact(found))


def retained(bars: DataFrame) -> DataFrame:
    """Bars that pass every structural check."""
    return with_violations(bars).where(F.size("violations") == 0).drop("violations")


def rejected(bars: DataFrame) -> DataFrame:
    """The other bars, each with its ``violations``."""
    return with_violations(bars).where(F.size("violations") > 0)


def quarantined(bars: DataFrame) -> DataFrame:
    """One event per structural violation."""
    return (
        rejected(bars)
        .withColumn("v", F.explode("violations"))
        .select(
            "instrument_id",
            "interval",
            F.col("v.check_name").alias("check_name"),
            F.lit("quarantined").alias("severity"),
            "open_time",
            F.col("v.details").alias("details"),
        )
    )


# -- sequences ----------------------------------------------------------------------------------


def event(check: Column | str, details: Column, open_time: Column | str = "open_time") -> list[Column]:
    """Columns of a flagged event."""
    check = F.lit(check) if isinstance(check, str) else check
    at = F.col(open_time) if isinstance(open_time, str) else open_time
    return [
        F.col("instrument_id"),
        F.col("interval"),
        check.alias("check_name"),
        F.lit("flagged").alias("severity"),
        at.alias("open_time"),
        details.alias("details"),
    ]


def _own(bars: DataFrame) -> DataFrame:
    return bars.where(~F.col(BEFORE)) if BEFORE in bars.columns else bars


def walked(bars: DataFrame, series: Series = ARRIVALS) -> DataFrame:
    """What sequence checks need of bars, with ``prev`` (the row before) and POSITION: one pass that all of them can start from."""
    if POSITION in bars.columns:
        return bars
    needed = dict.fromkeys([*series.keys, "open_time", "close", "volume", *series.order])
    return series.scan(bars.select(*needed), previous=["open_time"], index=POSITION)


def order_violations(bars: DataFrame, series: Series = ARRIVALS) -> DataFrame:
    """Bars that do not come after the one before, or come more than one step after it."""
    seen = bars if POSITION in bars.columns else series.previous(bars, ["open_time"])
    seen = _own(seen).where(F.col("prev").isNotNull())
    delta = F.unix_micros("open_time") - F.unix_micros("prev.open_time")
    step = step_seconds("interval") * 1_000_000
    before = F.col("prev.open_time").cast("string")
    here = F.col("open_time").cast("string")
    details = F.when(
        delta <= 0, F.create_map(F.lit("previous_open_time"), before)
    ).otherwise(F.create_map(F.lit("gap_start"), before, F.lit("gap_end"), here))
    check = F.when(delta <= 0, F.lit("timestamp_monotonic")).otherwise(F.lit("missing_interval"))
    return seen.where((delta <= 0) | (delta > step)).select(*event(check, details))


def zero_volume_streaks(bars: DataFrame, threshold: int = 5, series: Series = ARRIVALS) -> DataFrame:
    """One event per run of ``threshold`` or more zero-volume bars.

    It is stamped at the first bar with volume after the run, or at the last bar if there is none.
    """
    keys = list(series.keys)
    placed = walked(bars, series)
    traded = F.when(F.col("volume") != 0, F.col(POSITION))
    lengths = placed.groupBy(*keys).agg(F.max(POSITION).alias("_last"))
    runs = series.running(placed, {"_traded": Measure("max", traded, inclusive=False)}).join(lengths, keys)
    zeros = F.col(POSITION) - F.coalesce(F.col("_traded"), F.lit(0))
    at_end = (F.col(POSITION) == F.col("_last")) & (F.col("_last") >= 2)
    streak = F.when(F.col("volume") != 0, zeros - 1).when(at_end, zeros)
    details = F.create_map(F.lit("streak_length"), F.col("streak").cast("string"))
    return runs.withColumn("streak", streak).where(F.col("streak") >= max(threshold, 1)).select(*event("zero_volume_streak", details))


def price_moves(bars: DataFrame, window: int = 20, sigma: float = 10.0, series: Series = ARRIVALS) -> DataFrame:
    """Returns larger than ``sigma`` deviations of the ``window`` returns strictly before them."""
    close, keys = F.col("close").cast("double"), list(series.keys)

    def returns(w: Window) -> dict[str, Column]:
        before = F.lag(close).over(w)
        change = F.when(before == 0, F.lit(0.0)).otherwise(F.try_divide(close - before, before))
        return {"_return": change}

    def baseline(w: Window) -> dict[str, Column]:
        past = w.rowsBetween(-window, -1)
        full = F.count("_return").over(past) == window
        return {"_sigma": F.when(full, F.stddev_pop("_return").over(past))}

    needed = [*keys, *[c for c in ("open_time", "close") if c not in series.order], *series.order, *[c for c in (POSITION, BEFORE) if c in bars.columns]]
    moves = series.rolling(bars.select(*needed), window + 1, returns, baseline)
    size = F.abs("_return")
    details = F.create_map(
        F.lit("return"), F.col("_return").cast("string"),
        F.lit("stddev"), F.col("_sigma").cast("string"),
        F.lit("sigma_multiple"), (size / F.col("_sigma")).cast("string"),
    )
    return _own(moves).where((F.col("_sigma") > 0) & (size > F.lit(sigma) * F.col("_sigma"))).select(
        *event("price_move_sigma", details)
    )


def flagged(
    bars: DataFrame,
    series: Series = ARRIVALS,
    streak: int = 5,
    window: int = 20,
    sigma: float = 10.0,
) -> DataFrame:
    """All sequence events of a batch. The bars are walked once; the checks start from what that has stored."""
    path = scratch(bars.sparkSession, "walked")
    seen = walked(bars, series)
    seen.write.parquet(path)
    seen = bars.sparkSession.read.schema(seen.schema).parquet(path)
    return (
        order_violations(seen, series)
        .unionByName(zero_volume_streaks(seen, streak, series))
        .unionByName(price_moves(seen, window, sigma, series))
    )


def violations(bars: DataFrame, series: Series = ARRIVALS, **settings: object) -> DataFrame:
    """Quarantine events and flags together."""
    return quarantined(bars).unionByName(flagged(bars, series, **settings))


def count_by_check(events: DataFrame) -> DataFrame:
    return events.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


def event_log(events: DataFrame, detected_at: Column | datetime) -> DataFrame:
    """Events in the shape of the log table, details as JSON."""
    at = detected_at if isinstance(detected_at, Column) else F.lit(detected_at)
    return events.withColumn("details", F.to_json("details")).withColumn("detected_at", at)


def revalidate(
    candles: DataFrame, start: Column | datetime, end: Column | datetime, **settings: object
) -> DataFrame:
    """Re-check stored bars opening in [start, end], in time order; reads only."""
    low = start if isinstance(start, Column) else F.lit(start)
    high = end if isinstance(end, Column) else F.lit(end)
    stored = candles.where((F.col("open_time") >= low) & (F.col("open_time") <= high))
    return violations(stored, arrival_series("open_time", 86_400), **settings)


def boundary_gaps(
    bars: DataFrame, previous_bars: DataFrame | None = None, series: Series | None = None
) -> DataFrame:
    """Pairs of consecutive bars more than one step apart.

    ``previous_bars`` (keys + open_time) are bars known from before this batch; they count as the
    bar in front of it.
    """
    series = series or arrival_series("open_time", 86_400)
    wanted = [*series.keys, "open_time", *[c for c in series.order if c != "open_time"]]
    rows = bars.select(*wanted)
    if previous_bars is not None:
        rows = rows.unionByName(previous_bars.select(*wanted))
    seen = series.previous(rows, ["open_time"]).where(F.col("prev").isNotNull())
    apart = F.unix_micros("open_time") - F.unix_micros("prev.open_time")
    return seen.where(apart > step_seconds("interval") * 1_000_000).select(
        *series.keys, F.col("prev.open_time").alias("gap_start"), F.col("open_time").alias("gap_end")
    )
