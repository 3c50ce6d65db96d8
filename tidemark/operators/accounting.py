"""Fills to positions, fees, funding and equity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.intervals import plus_seconds
from tidemark.functions.money import FeeSchedule, signed_qty
from tidemark.plans import affine
from tidemark.plans.ordered import FILLS, Measure, Series, tidy

# One book per instrument of a run.
BOOKS = FILLS.with_(keys=("run_id", "instrument_id"))
_CENTS = "decimal(38,12)"
_FOLD_INPUT = ("_keep", "_add", "_gain", "_per_entry", "_fee")


def unique_fills(fills: DataFrame, series: Series = FILLS) -> DataFrame:
    """One row per fill id: the earliest delivery. Repeats combine map-side, however many."""
    ids = [*series.keys, "fill_id"]
    rest = [c for c in fills.columns if c not in ids and c != "ts"]
    return fills.groupBy(*ids).agg(F.min(F.struct("ts", *rest)).alias("_f")).select(*ids, "_f.*").select(*fills.columns)


def running_quantity(fills: DataFrame, series: Series = FILLS) -> DataFrame:
    """Add ``qty_before`` and ``qty_after``, exact signed positions."""
    signed = signed_qty()
    held = series.running(fills, {"qty_after": Measure("sum", signed)})
    return held.withColumn("qty_before", F.col("qty_after") - signed)


def replay(fills: DataFrame, series: Series = FILLS) -> DataFrame:
    """Positions after every fill, at weighted average cost.

    Adds ``previous_ts``, ``qty_before/qty_after``, ``avg_entry`` (after the fill), ``realized_pnl`` (running, fees
    included), ``is_closing`` and ``trade_pnl`` (closing fills only: price gain less their own fee).
    Needs columns side, qty, price, fee and the series' keys and order. Repeats of a fill id count
    once.

    A fill changes the average entry by an affine map, avg' = keep*avg + add, whose coefficients
    depend only on quantities, and quantities are a running sum. Maps compose, so each segment is
    folded into one map, the maps are chained per key, and every segment is then replayed on its
    own from the right start (see ``plans/affine.py``): no row is looped over, no group collected.
    """
    signed = signed_qty()
    # Segments are cut before repeats are dropped: a count that includes them only cuts finer.
    once = unique_fills(series.segment(fills), series)
    held = series.scan(once, {"qty_after": Measure("sum", signed)}, previous=["ts"])
    held = held.withColumns({"qty_before": F.col("qty_after") - signed, "previous_ts": F.col("prev.ts")}).drop("prev")
    before, after = F.col("qty_before").cast("double"), F.col("qty_after").cast("double")
    qty, price = F.col("qty").cast("double"), F.col("price").cast("double")
    same_side = (before == 0) | ((before > 0) == (F.col("side") == "buy"))
    flipped = (before > 0) != (after > 0)
    closed = F.least(F.abs(before), qty) * F.signum(before)
    held = held.withColumns(
        {
            "is_closing": ~same_side,
            "_keep": F.when(same_side, F.abs(before) / F.abs(after)).when((after == 0) | flipped, 0.0).otherwise(1.0),
            "_add": F.when(same_side, qty * price / F.abs(after)).when(after == 0, 0.0).when(flipped, price).otherwise(0.0),
            "_gain": F.when(same_side, 0.0).otherwise(closed * price),
            "_per_entry": F.when(same_side, 0.0).otherwise(closed),
            "_fee": F.col("fee").cast("double"),
        }
    )
    cluster = [*series.keys, series.seg]
    started = affine.in_groups(held.join(_segment_starts(held, series), cluster, "left"), cluster, series.order)
    columns = [*series.keys, *[c for c in held.columns if c not in (*cluster, *_FOLD_INPUT)]]
    schema = T.StructType([held.schema[c] for c in columns])
    for name in ("avg_entry", "realized_pnl", "trade_pnl"):
        schema.add(name, T.DoubleType())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        average = realized = 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            first = affine.flags(batch)
            keep, add, gain, per_entry, fee, avg0, pnl0 = affine.numbers(batch, *_FOLD_INPUT, "_avg0", "_pnl0")
            entries = affine.grouped_walk(keep, add, first, avg0, average)
            change = gain - per_entry * affine.before(entries, first, avg0, average) - fee
            totals = affine.grouped_walk(np.ones(len(change)), change, first, pnl0, realized)
            average, realized = float(entries[-1]), float(totals[-1])
            trades = pa.array(change, mask=~affine.flags(batch, "is_closing"))
            arrays = [*(batch.column(c) for c in columns), pa.array(entries), pa.array(totals), trades]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return started.mapInArrow(fold, schema)


def _segment_starts(held: DataFrame, series: Series) -> DataFrame:
    """Average entry and realised total in front of every segment (``_avg0``, ``_pnl0``).

    Segments fold into one map each, batch by batch; of the maps, one row per segment, keys are chained the same way.
    """
    keys, cluster = list(series.keys), [*series.keys, series.seg]
    places = T.StructType([held.schema[k] for k in cluster])
    figures = ("_a", "_b", "_p", "_q")
    composed = T.StructType([*places.fields, *[T.StructField(c, T.DoubleType()) for c in figures]])
    laid_out = affine.in_groups(held, cluster, series.order)
    maps = laid_out.mapInArrow(lambda batches: affine.group_maps(batches, cluster, _FOLD_INPUT, figures), composed)
    started = T.StructType([*places.fields, T.StructField("_avg0", T.DoubleType()), T.StructField("_pnl0", T.DoubleType())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        average = realized = 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            first = affine.flags(batch)
            a, b, p, q = affine.numbers(batch, *figures)
            averages = affine.grouped_walk(a, b, first, 0.0, average)
            ahead = affine.before(averages, first, 0.0, average)
            totals = affine.grouped_walk(np.ones(len(a)), p + q * ahead, first, 0.0, realized)
            starts = affine.before(totals, first, 0.0, realized)
            average, realized = float(averages[-1]), float(totals[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cluster), pa.array(ahead), pa.array(starts)], names=started.fieldNames())

    return affine.in_groups(maps, keys, [series.seg]).mapInArrow(chain, started)


# -- fees -----------------------------------------------------------------------------------------


def fill_fees(fills: DataFrame, schedule: FeeSchedule, volume: str = "thirty_day_volume") -> DataFrame:
    """Add ``fee``: notional times the maker or taker rate of the tier that ``volume`` reaches."""
    return fills.withColumn("fee", schedule.fee(F.col("qty"), F.col("price"), F.col(volume), F.col("is_maker")))


def trailing_volume(
    fills: DataFrame, keys: Sequence[str], days: int = 30, order_id: str = "fill_id", out: str = "thirty_day_volume"
) -> DataFrame:
    """Add the notional traded in the ``days`` before each fill, that fill not included.

    Every fill enters the sum at its time and leaves it ``days`` later, so the trailing sum is a
    running sum over entries and exits.
    """
    notional = (F.col("qty") * F.col("price")).cast("decimal(38,16)")
    entering = fills.select(*keys, F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col(order_id).alias("id"), notional.alias("amount"), F.struct(*fills.columns).alias("row"))
    leaving = entering.select(
        *keys, plus_seconds("at", days * 86_400).alias("at"), F.lit(0).alias("kind"), "id", (-F.col("amount")).cast("decimal(38,16)").alias("amount"),
        F.lit(None).cast(entering.schema["row"].dataType).alias("row"),
    )
    line = Series(tuple(keys), ("at", "kind", "id"), width=365 * 86_400)
    summed = line.running(entering.unionByName(leaving), {"held": Measure("sum", F.col("amount"), inclusive=False)})
    return summed.where(F.col("kind") == 1).select("row.*", F.coalesce(F.col("held"), F.lit(0).cast("decimal(38,16)")).alias(out))


# -- funding --------------------------------------------------------------------------------------


def funding_payments(observations: DataFrame, interval_seconds: int = 8 * 3600, key: str = "position_id") -> DataFrame:
    """One payment per interval boundary since ``opened_at`` that an observation is the first to pass.

    All boundaries an observation passes are paid on its own qty, mark and rate; ``amount`` is
    negative when the position pays. Needs ts, opened_at, qty, mark_price, funding_rate, obs_id.
    """
    if interval_seconds <= 0:
        raise ValueError("funding interval must be positive")
    since = F.unix_micros("ts") - F.unix_micros("opened_at")
    passed = F.greatest(F.floor(since / F.lit(interval_seconds * 1_000_000)), F.lit(0)).cast("long")
    line = Series((key,), ("ts", "obs_id"), width=365 * 86_400)
    seen = line.running(observations.withColumn("_k", passed), {"_paid": Measure("max", F.col("_k"), inclusive=False)})
    paid = F.coalesce(F.col("_paid"), F.lit(0).cast("long"))
    return seen.where(F.col("_k") > paid).select(
        key,
        F.explode(F.sequence(paid + 1, F.col("_k"))).alias("boundary"),
        "opened_at",
        (-(F.col("qty") * F.col("mark_price")).cast("double") * F.col("funding_rate").cast("double")).alias("amount"),
    ).select(key, plus_seconds("opened_at", F.col("boundary") * interval_seconds).alias("accrued_at"), "amount")


# -- equity ---------------------------------------------------------------------------------------


def _marked(bars: DataFrame, positions: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Series]:
    """Fills (kind 0, with ``state``) and closes (kind 1) of every book on one time line; a fill at a bar's own open time comes first."""
    state = F.struct("qty_after", "avg_entry", "realized_pnl")
    state_type = positions.select(state.alias("s")).schema["s"].dataType
    changes = positions.select(*keys, F.col("ts").alias("at"), F.lit(0).alias("kind"), F.col("fill_id").cast("string").alias("id"),
                               state.alias("state"), F.lit(None).cast(bars.schema["close"].dataType).alias("close"))
    marks = bars.select(*keys, F.col("open_time").alias("at"), F.lit(1).alias("kind"), F.lit("").alias("id"),
                        F.lit(None).cast(state_type).alias("state"), "close")
    return changes.unionByName(marks), Series(tuple(keys), ("at", "kind", "id"), width=30 * 86_400)


def _gain(state: str, close: str) -> Column:
    """Realised total plus what the open position is worth more than it cost; without a close it is worth its cost."""
    quantity = F.coalesce(F.col(f"{state}.qty_after").cast("double"), F.lit(0.0))
    entry = F.coalesce(F.col(f"{state}.avg_entry"), F.lit(0.0))
    open_gain = F.when((quantity != 0) & F.col(close).isNotNull(), quantity * (F.col(close).cast("double") - entry)).otherwise(0.0)
    return F.coalesce(F.col(f"{state}.realized_pnl"), F.lit(0.0)) + open_gain


def equity_curve(bars: DataFrame, positions: DataFrame, starting_cash: float, key: str = "run_id") -> DataFrame:
    """Mark every bar of a run to its close: cash + realised + qty * (close - average entry).

    ``positions`` is replay output; a fill at the bar's own open time already counts.
    """
    rows, line = _marked(bars, positions, [key])
    held = line.running(rows, {"held": Measure("last", F.col("state"))})
    value = F.lit(float(starting_cash)) + _gain("held", "close")
    return tidy(held.where(F.col("kind") == 1).select(key, F.col("at").alias("ts"), F.lit(0).alias("seq"), value.alias("equity")))


def portfolio_curve(bars: DataFrame, positions: DataFrame, starting_cash: float, key: str = "run_id", book: str = "instrument_id") -> DataFrame:
    """Equity of runs over several instruments, at every time one of them has a bar.

    Every fill and every close changes the worth of its own book; the changes of all books of a run at one time add up to
    one row, and equity is their running sum. So a book whose bars have a gap keeps its last close, no book
    waits for another, and neither the books of a run nor its time line are gathered. Sums are exact decimals: they
    do not drift.
    """
    rows, line = _marked(bars, positions, [key, book])
    state, close = F.col("state"), F.col("close")
    held = line.running(
        rows,
        {
            "_state": Measure("last", state), "_close": Measure("last", close),
            "_old_state": Measure("last", state, inclusive=False), "_old_close": Measure("last", close, inclusive=False),
        },
    )
    change = _gain("_state", "_close").cast(_CENTS) - _gain("_old_state", "_old_close").cast(_CENTS)
    changes = held.groupBy(key, "at").agg(F.sum(change.cast(_CENTS)).alias("change"), F.max("kind").alias("kind"))
    total = Series((key,), ("at",), width=30 * 86_400).running(changes, {"worth": Measure("sum", F.col("change"))})
    value = (F.lit(float(starting_cash)).cast(_CENTS) + F.col("worth")).cast("double")
    return tidy(total.where(F.col("kind") == 1).select(key, F.col("at").alias("ts"), F.lit(0).alias("seq"), value.alias("equity")))


def sequence_gaps(messages: DataFrame, stream: str = "stream", order: str = "arrival", seq: str = "seq") -> DataFrame:
    """Messages whose sequence number is not the one before plus one."""
    line = Series((stream,), (order,), width=1 << 20)
    seen = line.previous(messages.where(F.col(seq).isNotNull()), [seq])
    jumped = F.col("prev").isNotNull() & (F.col(seq) != F.col(f"prev.{seq}") + 1)
    return seen.where(jumped).select(
        stream, order, F.col(f"prev.{seq}").alias("previous_sequence"), F.col(seq).alias("received_sequence")
    )

