"""Which bars are missing from a window, as contiguous runs, and whether maintenance explains them.

Expected slots are never enumerated for bars that exist: bars are numbered on the slot grid and
compared with the one before, so only missing slots are ever materialised.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import step_seconds
from tidemark.plans.ordered import Measure, Series, tidy

_SLOTS = Series(("instrument_id", "interval"), ("slot",), width=1 << 14, segment_rows=None)
_TIMELINE = Series((), ("at", "kind", "start"), width=86_400)


def _lit(value: Column | datetime) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def gaps(
    candles: DataFrame,
    window_start: Column | datetime,
    window_end: Column | datetime,
    series_list: DataFrame | None = None,
) -> DataFrame:
    """Contiguous missing runs in the closed window, per (instrument_id, interval).

    ``window_start`` and ``window_end`` are constants. The grid starts at ``window_start`` and bars off it do not fill a slot. ``series_list`` names
    the series to scan, also such without any bar; by default those that have bars in the window.
    """
    start, end = _lit(window_start).cast("timestamp"), _lit(window_end).cast("timestamp")
    step = step_seconds("interval") * 1_000_000
    first = F.unix_micros(start)
    offset = F.unix_micros("open_time") - first
    wanted = series_list if series_list is not None else candles.where(F.col("open_time").between(start, end))
    # Sentinels stand one slot before and one after the window, so its edges need no special case.
    slots = F.floor((F.unix_micros(end) - first) / step).cast("long") + 1
    edges = (
        wanted.select("instrument_id", "interval")
        .distinct()
        .select("instrument_id", "interval", F.explode(F.array(F.lit(-1).cast("long"), slots)).alias("slot"))
    )
    present = (
        candles.where(F.col("open_time").between(start, end))
        .where(offset % step == 0)
        .select("instrument_id", "interval", (offset / step).cast("long").alias("slot"))
    )
    if series_list is not None:
        present = present.join(series_list.select("instrument_id", "interval").distinct(), ["instrument_id", "interval"], "left_semi")
    seen = _SLOTS.previous(present.unionByName(edges), ["slot"])
    at = lambda slot: F.timestamp_micros(first + slot * step)
    low, high = F.col("prev.slot") + 1, F.col("slot") - 1
    return tidy(
        seen.where(F.col("prev").isNotNull() & (high >= low)).select(
            "instrument_id",
            "interval",
            at(low).alias("gap_start"),
            at(high).alias("gap_end"),
            (high - low + 1).alias("missing_count"),
        )
    )


def missing_open_times(found: DataFrame) -> DataFrame:
    """Add ``missing_open_times``: every slot of the run."""
    step = step_seconds("interval") * 1_000_000
    slots = F.sequence(F.unix_micros("gap_start"), F.unix_micros("gap_end"), step)
    return found.withColumn("missing_open_times", F.transform(slots, lambda us: F.timestamp_micros(us)))


def missing_slots(
    candles: DataFrame, window_start: Column | datetime, window_end: Column | datetime, series_list: DataFrame | None = None
) -> DataFrame:
    """Expected minus actual: one row per missing bar."""
    found = missing_open_times(gaps(candles, window_start, window_end, series_list))
    return found.select("instrument_id", "interval", F.explode("missing_open_times").alias("open_time"))


def classify(found: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Add ``classification``: maintenance if the run touches a window (closed ends), else unexplained.

    A window meets [gap_start, gap_end] exactly when, among windows starting no later than gap_end,
    the latest end reaches gap_start. That is one running maximum along the time line: no cross
    join, and no limit on the number of windows.
    """
    window_rows = maintenance.select(
        F.col("window_start").alias("at"),
        F.lit(0).alias("kind"),
        F.col("window_start").alias("start"),
        F.col("window_end").alias("until"),
        F.lit(None).cast(found.select(F.struct("*").alias("g")).schema["g"].dataType).alias("gap"),
    )
    gap_rows = found.select(
        F.col("gap_end").alias("at"),
        F.lit(1).alias("kind"),
        F.col("gap_start").alias("start"),
        F.lit(None).cast("timestamp").alias("until"),
        F.struct(*found.columns).alias("gap"),
    )
    lined = _TIMELINE.running(window_rows.unionByName(gap_rows), {"reach": Measure("max", F.col("until"))})
    explained = F.coalesce(F.col("reach") >= F.col("start"), F.lit(False))
    return lined.where(F.col("kind") == 1).select(
        "gap.*", F.when(explained, F.lit("maintenance")).otherwise(F.lit("unexplained")).alias("classification")
    )


def summary(classified: DataFrame) -> DataFrame:
    """Gaps and missing bars per classification."""
    return classified.groupBy("classification").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("missing_count").alias("missing_count")
    )


def gap_events(classified: DataFrame) -> DataFrame:
    """One log event per gap."""
    details = F.create_map(
        F.lit("gap_start"), F.col("gap_start").cast("string"),
        F.lit("gap_end"), F.col("gap_end").cast("string"),
        F.lit("missing_count"), F.col("missing_count").cast("string"),
        F.lit("classification"), F.col("classification"),
        F.lit("detected_by"), F.lit("gap_scanner"),
    )
    return classified.select(
        "instrument_id",
        "interval",
        F.lit("missing_interval").alias("check_name"),
        F.lit("flagged").alias("severity"),
        F.col("gap_start").alias("open_time"),
        details.alias("details"),
    )


def ranges_to_backfill(classified: DataFrame) -> DataFrame:
    """The unexplained gaps, as closed ranges to fetch."""
    return classified.where(F.col("classification") == "unexplained").select(
        "instrument_id",
        "interval",
        F.col("gap_start").alias("range_start"),
        F.col("gap_end").alias("range_end"),
    )
