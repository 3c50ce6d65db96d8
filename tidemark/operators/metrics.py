"""Performance figures of many runs at once. Undefined ratios are NULL, never 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import elapsed_days
from tidemark.functions.money import single_currency
from tidemark.operators.accounting import replay
from tidemark.plans.ordered import EQUITY, FILLS, Measure, Series

_DAYS_PER_YEAR = 365.25


def _equity() -> Column:
    return F.col("equity").cast("double")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, F.nullif(bottom, F.lit(0.0)))


def _returns(strict: bool) -> Column:
    before = F.col("prev.equity").cast("double")
    complaint = F.lit("no return can be told from an equity of zero or less")
    bad = F.raise_error(complaint).cast("double") if strict else F.lit(None).cast("double")
    return F.when(before > 0, (_equity() - before) / before).when(before <= 0, bad)


def _peak(axis: str) -> Measure:
    """The highest equity so far with its earliest time."""
    return Measure("max", F.struct(_equity().alias("e"), (-F.unix_micros(axis)).alias("t")))


def _below_peak(axis: str) -> dict[str, Column]:
    peak = F.col("_peak.e")
    return {
        "peak": peak,
        "drawdown": F.when(peak > 0, (peak - _equity()) / peak).otherwise(0.0),
        "days_since_peak": elapsed_days(F.timestamp_micros(-F.col("_peak.t")), F.col(axis)),
    }


def period_returns(equity: DataFrame, series: Series = EQUITY, strict: bool = True) -> DataFrame:
    """Add ``period_return``; NULL on the first point.

    A return from equity <= 0 raises, or is NULL when not strict.
    """
    seen = series.previous(equity, ["equity"])
    return seen.withColumn("period_return", _returns(strict)).drop("prev")


def drawdowns(equity: DataFrame, series: Series = EQUITY) -> DataFrame:
    """Add ``peak``, ``drawdown`` (fraction below it) and ``days_since_peak``.

    The peak's time is that of its first occurrence: a plateau at the peak counts as duration.
    """
    seen = series.running(equity, {"_peak": _peak(series.order[0])})
    return seen.withColumns(_below_peak(series.order[0])).drop("_peak")


def equity_metrics(
    equity: DataFrame, risk_free_rate: float = 0.0, periods_per_year: int = 252, series: Series = EQUITY, strict: bool = True
) -> DataFrame:
    """Return, growth, drawdown and risk ratios, one row per run, in one pass over the curve."""
    if periods_per_year < 1:
        raise ValueError("a year needs at least one period")
    seen = series.scan(equity, {"_peak": _peak(series.order[0])}, previous=["equity"])
    points = seen.withColumns({"period_return": _returns(strict), **_below_peak(series.order[0])})
    axis, rf, year = series.order[0], F.lit(float(risk_free_rate)), math.sqrt(periods_per_year)
    r, place = F.col("period_return"), F.struct(*series.order)
    totals = points.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(_equity(), place).alias("start_equity"),
        F.max_by(_equity(), place).alias("end_equity"),
        F.min(axis).alias("start_ts"),
        F.max(axis).alias("end_ts"),
        F.max("drawdown").alias("max_drawdown"),
        F.max("days_since_peak").alias("drawdown_duration_days"),
        F.avg(r).alias("_mean"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("_deviation"),
        # least() skips NULL: the first point has no return and must not count as one of zero.
        F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r - rf, F.lit(0.0)), 2)))).alias("_downside"),
        F.sum(F.greatest(r - rf, F.lit(0.0))).alias("_gains"),
        F.sum(F.greatest(rf - r, F.lit(0.0))).alias("_losses"),
    )
    start, end = F.col("start_equity"), F.col("end_equity")
    days = elapsed_days("start_ts", "end_ts")
    growth = F.pow(_ratio(end, start), _ratio(F.lit(_DAYS_PER_YEAR), days)) - 1
    finite = ~F.isnan(growth) & (F.abs(growth) < F.lit(math.inf))
    out = totals.withColumns(
        {
            "total_return": _ratio(end - start, start),
            "total_days": days,
            "cagr": F.when((days > 0) & (end > 0) & (start > 0) & finite, growth),
            "sharpe": _ratio(F.col("_mean") - rf, F.col("_deviation")) * year,
            "sortino": _ratio(F.col("_mean") - rf, F.col("_downside")) * year,
            "omega": _ratio(F.col("_gains"), F.col("_losses")),
        }
    )
    return out.withColumn("calmar", _ratio(F.col("cagr"), F.col("max_drawdown"))).drop(
        "_mean", "_deviation", "_downside", "_gains", "_losses"
    )


def _fee_sums() -> list[Column]:
    return [
        F.sum("fee").cast("double").alias("total_fees"),
        single_currency("currency").alias("currency"),
        F.count(F.lit(1)).alias("fills"),
    ]


def fee_totals(fills: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Total fees per run; a run that mixes currencies raises."""
    return fills.groupBy(*keys).agg(*_fee_sums())


def fees_pct_of_gross(fees: Column, equity_change: Column) -> Column:
    """Fees in percent of the profit before fees, by absolute value."""
    return 100.0 * _ratio(fees, F.abs(equity_change + fees))


def _trade_sums() -> list[Column]:
    pnl, closing = F.col("trade_pnl"), F.col("is_closing")
    return [
        F.count_if(closing).alias("trades"),
        F.count_if(closing & (pnl > 0)).alias("wins"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("_profit"),
        F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("_loss"),
        F.avg(F.when(pnl > 0, pnl)).alias("avg_win"),
        F.avg(F.when(pnl < 0, pnl)).alias("avg_loss"),
        F.avg(F.when(closing, pnl)).alias("expectancy"),
    ]


def _trade_ratios() -> dict[str, Column]:
    return {
        "win_rate": F.try_divide(F.col("wins").cast("double"), F.col("trades").cast("double")),
        "profit_factor": F.when(F.col("trades") > 0, _ratio(F.col("_profit"), F.col("_loss"))),
    }


def trade_metrics(positions: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Win rate, profit factor, averages and expectancy over closing fills."""
    return positions.groupBy(*keys).agg(*_trade_sums()).withColumns(_trade_ratios()).drop("_profit", "_loss")


def _market_days(series: Series) -> list[Column]:
    held = F.when(F.col("qty_before") != 0, elapsed_days("previous_ts", "ts")).otherwise(0.0)
    return [
        F.sum(F.coalesce(held, F.lit(0.0))).alias("days_between_fills"),
        F.max_by("qty_after", F.struct(*series.order)).alias("final_qty"),
        F.max("ts").alias("last_fill_ts"),
    ]


def _shared_market_days(positions: DataFrame, key: str) -> DataFrame:
    """As ``_market_days`` for runs of several books: time counts while any of them is open. ``final_qty`` is the number of books left open."""
    step = (F.col("qty_after") != 0).cast("long") - (F.col("qty_before") != 0).cast("long")
    steps = positions.groupBy(key, F.col("ts").alias("at")).agg(F.sum(step).alias("step"))
    line = Series((key,), ("at",), width=365 * 86_400)
    seen = line.scan(steps, {"_open": Measure("sum", F.col("step"), inclusive=False)}, previous=["at"])
    held = F.when(F.col("_open") > 0, elapsed_days("prev.at", "at")).otherwise(0.0)
    return seen.groupBy(key).agg(F.sum(held).alias("days_between_fills"), F.sum("step").alias("final_qty"), F.max("at").alias("last_fill_ts"))


def _market_share() -> Column:
    """Time with an open position over the run's span, an open tail included."""
    tail = F.when(F.col("final_qty") != 0, elapsed_days("last_fill_ts", "end_ts")).otherwise(0.0)
    days = F.coalesce(F.col("days_between_fills") + tail, F.lit(0.0))
    return F.when(F.col("total_days") > 0, days / F.col("total_days")).otherwise(0.0)


def time_in_market(positions: DataFrame, spans: DataFrame, series: Series = FILLS) -> DataFrame:
    """Share of the run's span with an open position; ``spans`` holds end_ts and total_days."""
    keys = list(series.keys)
    joined = spans.join(positions.groupBy(*keys).agg(*_market_days(series)), keys, "left")
    return joined.select(*keys, _market_share().alias("time_in_market"))


TEARSHEET = (
    "total_return", "cagr", "max_drawdown", "drawdown_duration_days", "sharpe", "sortino", "calmar",
    "omega", "win_rate", "profit_factor", "avg_win", "avg_loss", "expectancy", "time_in_market",
    "total_fees", "slippage", "fees_pct_of_gross", "currency",
)


def tearsheet(
    equity: DataFrame,
    fills: DataFrame,
    risk_free_rate: float = 0.0,
    periods_per_year: int = 252,
    slippage: DataFrame | None = None,
    positions: DataFrame | None = None,
    strict: bool = False,
    book: str | None = None,
) -> DataFrame:
    """One row per run of either table, with every figure that can be told.

    With ``book`` a run has one position per value of that column, and is in the market while any of them is open.

    ``problem`` says what a run lacks: ``equity`` (fewer than two points) or ``fills`` (none); then figures that
    need it are NULL, and fees and time in market without fills 0. With ``strict`` a run with a problem raises. ``slippage`` (run_id, slippage) is what fills alone cannot tell; without it the figure is NULL.
    """
    curve = equity_metrics(equity, risk_free_rate, periods_per_year)
    books = FILLS if book is None else FILLS.with_(keys=(*FILLS.keys, book))
    positions = positions if positions is not None else replay(fills, books)
    if book is None:
        per_run = positions.groupBy(*FILLS.keys).agg(*_fee_sums(), *_trade_sums(), *_market_days(FILLS))
    else:
        sums = positions.groupBy("run_id").agg(*_fee_sums(), *_trade_sums())
        per_run = sums.join(_shared_market_days(positions, "run_id"), "run_id")
    sheet = curve.join(per_run.withColumn("traded", F.lit(True)), "run_id", "full").withColumns({**_trade_ratios(), "time_in_market": _market_share()})
    short, idle = F.coalesce(F.col("points") < 2, F.lit(True)), F.col("traded").isNull()
    problem = F.when(short, "equity").when(idle, "fills")
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("run"), F.col("run_id").cast("string"), F.lit("lacks"), problem)))
    sheet = sheet.withColumn("problem", problem.cast("string"))
    curve_figures = [c for c in curve.columns if c != "run_id"]
    sheet = sheet.withColumns({c: F.when(~short, F.col(c)) for c in curve_figures})
    sheet = sheet.withColumns({c: F.when(idle, F.lit(0)).otherwise(F.col(c)).cast(sheet.schema[c].dataType) for c in ("total_fees", "time_in_market")})
    change = F.col("end_equity") - F.col("start_equity")
    sheet = sheet.withColumn("fees_pct_of_gross", fees_pct_of_gross(F.col("total_fees"), change))
    if slippage is None:
        sheet = sheet.withColumn("slippage", F.lit(None).cast("double"))
    else:
        sheet = sheet.join(slippage.select("run_id", F.col("slippage").cast("double")), "run_id", "left")
    return sheet.select("run_id", *TEARSHEET, "problem")


def tearsheet_json(sheet: DataFrame) -> DataFrame:
    """The tearsheet as one JSON object per run, numbers as text, NULLs kept."""
    body = F.struct(*[F.col(c).cast("string").alias(c) for c in TEARSHEET])
    return sheet.select("run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("tearsheet"))


def run_counters(signals: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Bars seen, chances to signal, signals made and signals dropped in warm-up, per run."""
    warm, made = F.col("in_warmup"), F.col("signal").isNotNull()
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars_processed"),
        F.count_if(~warm).alias("signal_opportunities"),
        F.count_if(~warm & made).alias("signals_produced"),
        F.count_if(warm & made).alias("signals_discarded_during_warmup"),
    )

