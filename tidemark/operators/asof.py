"""Joins along time: next bar, last n bars, event order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import close_time, step_seconds
from tidemark.plans.ordered import BARS, Measure, Series, tidy

BAR_COLUMNS = ("open_time", "open", "high", "low", "close", "volume")


def next_bars(bars: DataFrame, series: Series = BARS) -> DataFrame:
    """Each bar with ``signal_time``, the open time of the bar before it.

    Joining orders on ``signal_time`` gives them bar t+1 and can never give them bar t. The first
    bar of a series answers no order; an order on the last bar finds no row and is dropped.
    """
    seen = series.previous(bars, ["open_time"]).where(F.col("prev").isNotNull())
    return tidy(seen.withColumn("signal_time", F.col("prev.open_time")).drop("prev"))


def join_next_bar(orders: DataFrame, bars: DataFrame, series: Series = BARS) -> DataFrame:
    """Orders (instrument_id, interval, signal_time, ...) with the bar they may execute on.

    The bar's columns come as a struct ``bar``.
    """
    keys = [*series.keys, "signal_time"]
    following = next_bars(bars, series).select(*keys, F.struct(*BAR_COLUMNS).alias("bar"))
    return orders.join(following, keys)


def last_n_bars(
    requests: DataFrame,
    bars: DataFrame,
    n: int | Column,
    request_id: str = "request_id",
    series: Series = BARS,
) -> DataFrame:
    """The last ``n`` bars that closed strictly before each request's ``ts``.

    One row per (request, bar), ``bar_rank`` 1 being the latest. Fewer rows where fewer bars exist,
    none for n <= 0. A bar that closes exactly at ``ts`` is not visible yet.
    """
    keys = list(series.keys)
    numbered = series.index(bars, "bar_no").drop(series.seg)
    marks = numbered.select(
        *keys, close_time().alias("at"), F.lit(1).alias("kind"), "bar_no", F.lit(None).cast(requests.schema[request_id].dataType).alias(request_id)
    )
    asks = requests.select(
        *keys, F.col("ts").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("bar_no"), request_id
    )
    # Requests sort before bars at the same instant, which makes "before" strict.
    # Segments are cut like those of the bars; a busy series is cut further by its requests.
    timeline = Series(series.keys, ("at", "kind", "bar_no", request_id), series.width, 1_000_000, in_steps=series.in_steps)
    seen = timeline.running(marks.unionByName(asks), {"last_no": Measure("max", F.col("bar_no"))})
    count = F.lit(n) if isinstance(n, int) else n
    wanted = (
        seen.where((F.col("kind") == 0) & (F.col("last_no") >= 1) & (count > 0))
        .select(*keys, request_id, F.col("at").alias("ts"), "last_no",
                F.explode(F.sequence(F.greatest(F.col("last_no") - count + 1, F.lit(1).cast("long")), F.col("last_no"))).alias("bar_no"))
        .withColumn("bar_rank", F.col("last_no") - F.col("bar_no") + 1)
        .drop("last_no")
    )
    return wanted.join(numbered.select(*keys, "bar_no", *BAR_COLUMNS), [*keys, "bar_no"]).drop("bar_no")


def event_order(bars: DataFrame, tie_break: Sequence[str] = ("instrument_id",), width: int = 86_400) -> DataFrame:
    """Bars of all series in the order a live feed would deliver them, numbered by ``event_no``.

    They sort by close time; at the same instant shorter bars come first, so an hourly bar follows
    its sixty minutes, then by ``tie_break``. Numbering needs no global sort: positions are counted
    per slice of time and offset.
    """
    timed = bars.withColumn("close_time", close_time()).withColumn("step_s", step_seconds("interval"))
    line = Series((), ("close_time", "step_s", *tie_break), width=width)
    return tidy(line.index(timed, "event_no"))

