"""Composite jobs: ingest, re-validation, gap scan, backfill planning, backtests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import is_closed, plus_seconds, step_seconds
from tidemark.functions.money import FeeSchedule, SlippageModel, half_spread_plus_impact
from tidemark.operators import accounting, continuity, execution, gaps, metrics, quality
from tidemark.plans.ordered import FILLS, Series, tidy
from tidemark.schemas import MONEY
from tidemark.session import scratch
from tidemark.sources.store import upsert

def staged(df: DataFrame, path: str) -> DataFrame:
    """Write a table and go on from what was written: later stages start from files, not from a
    plan that repeats everything before them."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- ingest -------------------------------------------------------------------------------------


def validate_and_ingest(
    batch: DataFrame, stored: DataFrame, source: str, now: datetime, series: Series = quality.ARRIVALS, **settings: object
) -> tuple[DataFrame, DataFrame]:
    """(candle table after the batch, events to log). Only structurally sound bars are stored.

    Sequence checks of a series go on from the stored bars in front of the batch.
    """
    stamped = (
        quality.retained(batch)
        .withColumn("is_closed", is_closed(now))
        .withColumn("source", F.lit(source))
        .withColumn("trade_count", F.lit(0).cast("long"))
    )
    table = upsert(stored, stamped, arrival=series.order[0])
    tail = continuity.stored_tail(stored, batch, settings.get("window", 20))
    flags, _ = continuity.checked(batch, tail, series, **settings)
    events = quality.quarantined(batch).unionByName(flags.select(*quality.EVENT_COLUMNS))
    return table, quality.event_log(events, now)


# -- gaps ---------------------------------------------------------------------------------------


def gap_scan(
    candles: DataFrame,
    window_start: datetime | Column,
    window_end: datetime | Column,
    maintenance: DataFrame,
    workdir: str | None = None,
    series_list: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified gaps, events to log, ranges to backfill).

    ``series_list`` (instrument_id, interval) names what is expected: a series without any bar is one gap. By
    default it is what has bars within the window. The gaps are written below ``workdir`` once; everything after starts from there.
    """
    workdir = workdir or scratch(candles.sparkSession, "gap-scan")
    found = staged(gaps.gaps(candles, window_start, window_end, series_list), f"{workdir}/gaps")
    known = gaps.classify(found, maintenance)
    return known, gaps.gap_events(known), gaps.ranges_to_backfill(known)


RANGE_KEY = ("instrument_id", "interval", "range_start", "range_end")


def backfill_progress(landed: DataFrame) -> DataFrame:
    """The checkpoint of every range bars have landed for: its last bar."""
    return landed.groupBy(*RANGE_KEY).agg(F.max("open_time").alias("last_completed_open_time"))


def resume_plan(ranges: DataFrame, progress: DataFrame) -> DataFrame:
    """Where to continue each closed range, and whether anything is left of it."""
    step = step_seconds("interval")
    resume = F.coalesce(plus_seconds("last_completed_open_time", step), F.col("range_start"))
    return (
        ranges.join(progress, list(RANGE_KEY), "left")
        .withColumn("resume_from", resume)
        .withColumn("completed", F.col("resume_from") > F.col("range_end"))
    )


# -- backtests ----------------------------------------------------------------------------------

SignalRule = Callable[[DataFrame], DataFrame]
RUN_BARS = Series(("run_id",), ("open_time",), width=8_192, segment_rows=None, in_steps=True)


def toggle_rule(every: str | int) -> SignalRule:
    """Alternate buy and sell on every ``every``-th bar (a number or a column), from the first on."""

    def rule(bars: DataFrame) -> DataFrame:
        number = F.col("bar_no") - 1
        length = F.lit(every) if isinstance(every, int) else F.col(every)
        side = F.when((number / length).cast("long") % 2 == 0, "buy").otherwise("sell")
        return bars.withColumn("signal", F.when(number % length == 0, side))

    return rule


def signals(bars: DataFrame, rule: SignalRule, warmup: int, series: Series = RUN_BARS) -> DataFrame:
    """Bars of every run with ``bar_no``, the rule's ``signal`` and ``in_warmup``.

    A rule gets the bars of all runs, numbered from 1, and adds ``signal`` (buy, sell or NULL).
    """
    numbered = series.index(bars, "bar_no")
    return rule(numbered).withColumn("in_warmup", F.col("bar_no") <= F.lit(warmup))


def market_fills(signalled: DataFrame, qty: Decimal, fee_rate: Decimal, currency: str, series: Series = RUN_BARS) -> DataFrame:
    """Signals outside warm-up, filled whole at the open of the next bar. The last bar's is dropped."""
    seen = tidy(series.previous(signalled, ["signal", "in_warmup", "open_time"]))
    made = seen.where(F.col("prev.signal").isNotNull() & ~F.col("prev.in_warmup"))
    keys = list(series.keys)
    amount = F.lit(qty).cast(MONEY)
    return made.select(
        *keys,
        F.unix_micros("prev.open_time").alias("fill_id"),
        F.col("open_time").alias("ts"),
        F.col("prev.signal").alias("side"),
        amount.alias("qty"),
        F.col("open").alias("price"),
        (F.col("open") * amount * F.lit(fee_rate)).cast(MONEY).alias("fee"),
        F.lit(currency).alias("currency"),
    )


@dataclass(frozen=True)
class Execution:
    """How orders meet the next bar: fee tiers by the run's own 30-day volume, slippage, and what a bar allows."""

    schedule: FeeSchedule
    slippage: SlippageModel = half_spread_plus_impact
    max_volume_fraction: Decimal = Decimal(1)
    spread: float = 0.0
    volatility: float = 0.0
    lot_size: Decimal = Decimal("0.00000001")
    min_notional: Decimal = Decimal(0)
    available_balance: Decimal = Decimal("9999999999")


def executed_fills(signalled: DataFrame, qty: Decimal, currency: str, how: Execution, series: Series = RUN_BARS) -> DataFrame:
    """Signals outside warm-up as orders on the next bar: what fills, at which slipped price, at the fee of the tier reached.

    ``slippage`` is what the price lost against the open. What a bar does not fill lapses with it.
    """
    seen = tidy(series.previous(signalled, ["signal", "in_warmup", "open_time"]))
    made = seen.where(F.col("prev.signal").isNotNull() & ~F.col("prev.in_warmup"))
    keys = list(series.keys)
    money = lambda v: F.lit(v).cast(MONEY)
    orders = made.select(
        *keys,
        F.unix_micros("prev.open_time").alias("fill_id"),
        F.col("prev.signal").alias("side"),
        money(qty).alias("qty"),
        money(0).alias("filled_qty"),
        money(how.lot_size).alias("lot_size"),
        money(how.min_notional).alias("min_notional"),
        F.lit(how.spread).alias("spread"),
        F.lit(how.volatility).alias("volatility"),
        money(how.available_balance).alias("available_balance"),
        F.lit(currency).alias("balance_currency"),
        F.lit(currency).alias("quote_currency"),
        F.lit(False).alias("is_maker"),
        F.lit(0).alias("thirty_day_volume"),
        F.struct("open_time", "open", "volume").alias("bar"),
    )
    done = execution.evaluate_orders(orders, how.schedule, how.slippage, how.max_volume_fraction).where(F.col("fill_qty").isNotNull())
    fills = done.select(
        *keys,
        "fill_id",
        F.col("fill_ts").alias("ts"),
        "side",
        F.col("fill_qty").cast(MONEY).alias("qty"),
        F.col("fill_price").cast(MONEY).alias("price"),
        "is_maker",
        F.lit(currency).alias("currency"),
        (F.abs(F.col("fill_price") - F.col("bar.open")) * F.col("fill_qty")).cast("double").alias("slippage"),
    )
    # The volume that counts is the run's, over all its books; fills of several books at one time need an order of their own.
    placed = fills.withColumn("_place", F.struct("fill_id", *keys[1:]))
    fees = accounting.fill_fees(accounting.trailing_volume(placed, ["run_id"], order_id="_place"), how.schedule)
    return fees.withColumn("fee", F.col("fee").cast(MONEY)).drop("_place")


def backtest(
    bars: DataFrame,
    rule: SignalRule,
    warmup: int = 0,
    qty: Decimal = Decimal(1),
    fee_rate: Decimal = Decimal("0.001"),
    currency: str = "USDT",
    starting_cash: float = 100_000.0,
    periods_per_year: int = 252,
    workdir: str | None = None,
    how: Execution | None = None,
    book: str | None = None,
) -> dict[str, DataFrame]:
    """Every run of ``bars`` (keyed by run_id) at once: signals, counters, fills, positions, equity, tearsheet.

    Without ``how`` orders fill whole at the next open at one ``fee_rate``; with it by ``executed_fills``, and the
    tearsheet has the slippage of each run.

    With ``book`` (a column such as instrument_id) a run trades several instruments: bars are numbered, rules seen and
    orders filled per book, every book has its own position, and equity is that of the run (``accounting.portfolio_curve``).

    Fills, positions and equity are tables of their own below ``workdir`` (by default a fresh folder in the
    shared scratch space): each is read several times.
    """
    workdir = workdir or scratch(bars.sparkSession, "backtest")
    keys = ("run_id",) if book is None else ("run_id", book)
    line = RUN_BARS.with_(keys=keys)
    signalled = signals(bars, rule, warmup, line)
    made = market_fills(signalled, qty, fee_rate, currency, line) if how is None else executed_fills(signalled, qty, currency, how, line)
    fills = staged(made, f"{workdir}/fills")
    slippage = None if how is None else fills.groupBy("run_id").agg(F.sum("slippage").alias("slippage"))
    positions = staged(accounting.replay(fills, FILLS.with_(keys=keys)), f"{workdir}/positions")
    curve = accounting.equity_curve(bars, positions, starting_cash) if book is None else accounting.portfolio_curve(bars, positions, starting_cash, book=book)
    equity = staged(curve, f"{workdir}/equity")
    return {
        "signals": signalled,
        "counters": metrics.run_counters(signalled),
        "fills": fills,
        "positions": positions,
        "equity": equity,
        "tearsheet": metrics.tearsheet(equity, fills, periods_per_year=periods_per_year, positions=positions, slippage=slippage, book=book),
    }
