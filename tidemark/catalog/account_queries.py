"""Fills, fees, positions, equity, run metrics and whole backtests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EQUITY_SQL,
    FILLS_SQL,
    WITH_CANDLES,
    candles,
    equity,
    fills,
    query,
    r6,
    redelivered,
    table,
    us,
)
from tidemark.functions.money import (
    FeeSchedule,
    FeeTier,
    currency_conflicts,
    half_spread_plus_impact,
    notional,
    signed_qty,
    slipped_price,
)
from tidemark.operators import accounting, asof, execution, metrics, orders, resting, rules
from tidemark.plans import jobs
from tidemark.plans.ordered import Series
from tidemark.schemas import MONEY

_FILLS = f"WITH RECURSIVE fills AS ({FILLS_SQL})"
_EQUITY = f"WITH RECURSIVE equity AS ({EQUITY_SQL})"

SCHEDULE = FeeSchedule(
    (
        FeeTier(Decimal("0"), Decimal("0.0010"), Decimal("0.0015")),
        FeeTier(Decimal("500"), Decimal("0.0008"), Decimal("0.0012")),
        FeeTier(Decimal("2000"), Decimal("0.0005"), Decimal("0.0010")),
    )
)


def rate_sql(volume: str, maker: str) -> str:
    return (
        f"CASE WHEN {maker} THEN CASE WHEN {volume} >= 2000 THEN 0.0005 WHEN {volume} >= 500 THEN 0.0008 ELSE 0.0010 END"
        f" ELSE CASE WHEN {volume} >= 2000 THEN 0.0010 WHEN {volume} >= 500 THEN 0.0012 ELSE 0.0015 END END"
    )


# -- columns ------------------------------------------------------------------------------------


@query("b3_notional", f"{_FILLS} SELECT fill_id, {r6('CAST(qty AS DECIMAL(19,8)) * price')} AS notional, {r6('''CASE WHEN side = 'buy' THEN qty ELSE -qty END''')} AS signed_qty FROM fills")
def b3_notional(spark: SparkSession, sf: str) -> DataFrame:
    return fills(spark, sf).select("fill_id", notional().alias("notional"), signed_qty().alias("signed_qty"))


@query(
    "b11_currency_guard",
    """SELECT o_custkey AS run_id, min(o_orderpriority) AS first_currency, max(o_orderpriority) AS last_currency FROM orders GROUP BY 1
    HAVING min(o_orderpriority) <> max(o_orderpriority)""",
)
def b11_currency_guard(spark: SparkSession, sf: str) -> DataFrame:
    # The order priority stands in for a currency, so most customers mix several.
    money_rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("currency"))
    return currency_conflicts(money_rows, ["run_id"])


_BAR_SLIP = f"{WITH_CANDLES} SELECT instrument_id, {us('open_time')} AS open_time"


@query(
    "b12_slipped_price",
    f"""{_BAR_SLIP}, {r6('open + (0.02 / 2 + (trade_count / 10.0) * 0.05)')} AS buy_price, {r6('open - (0.02 / 2 + (trade_count / 10.0) * 0.05)')} AS sell_price FROM candles""",
)
def b12_slipped_price(spark: SparkSession, sf: str) -> DataFrame:
    amount = half_spread_plus_impact(F.lit(0.02), F.col("trade_count") / F.lit(10.0), F.lit(0.05))
    open_ = F.col("open").cast("double")
    return candles(spark, sf).select(
        "instrument_id", "open_time", slipped_price(open_, F.lit("buy"), amount).alias("buy_price"), slipped_price(open_, F.lit("sell"), amount).alias("sell_price")
    )


@query(
    "k5_custom_slippage",
    f"""{_BAR_SLIP}, {r6('open + 0.5 * sqrt(trade_count / 10.0)')} AS buy_price FROM candles""",
)
def k5_custom_slippage(spark: SparkSession, sf: str) -> DataFrame:
    square_root = lambda spread, share, volatility: volatility * F.sqrt(share)
    amount = square_root(F.lit(0.0), F.col("trade_count") / F.lit(10.0), F.lit(0.5))
    return candles(spark, sf).select("instrument_id", "open_time", slipped_price(F.col("open").cast("double"), F.lit("buy"), amount).alias("buy_price"))


# -- fees ---------------------------------------------------------------------------------------

_VOLUME = f"""{_FILLS}, vol AS (SELECT *, coalesce(CAST(sum(CAST(qty AS DECIMAL(19,8)) * price) OVER (PARTITION BY run_id ORDER BY ts, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS volume FROM fills)"""


def _with_volume(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.trailing_volume(fills(spark, sf).drop("fee"), ["run_id"])


@query("c7_fee_tier", f"{_VOLUME} SELECT fill_id, {r6('volume')} AS volume, CASE WHEN volume >= 2000 THEN 2000::DOUBLE WHEN volume >= 500 THEN 500::DOUBLE ELSE 0::DOUBLE END AS threshold FROM vol")
def c7_fee_tier(spark: SparkSession, sf: str) -> DataFrame:
    volume = F.col("thirty_day_volume")
    return _with_volume(spark, sf).select("fill_id", volume.alias("volume"), SCHEDULE.threshold(volume).alias("threshold"))


@query(
    "c7_tier_expiry",
    f"""{_FILLS}, vol AS (SELECT *, coalesce(CAST(sum(CAST(qty AS DECIMAL(19,8)) * price) OVER (PARTITION BY run_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS DOUBLE), 0) AS volume FROM fills)
    SELECT fill_id, {r6('volume')} AS volume, CASE WHEN volume >= 2000 THEN 2000::DOUBLE WHEN volume >= 500 THEN 500::DOUBLE ELSE 0::DOUBLE END AS threshold FROM vol""",
)
def c7_tier_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Volume that leaves the window again: seven days of thirty."""
    volume = F.col("thirty_day_volume")
    seen = accounting.trailing_volume(fills(spark, sf).drop("fee"), ["run_id"], days=7)
    return seen.select("fill_id", volume.alias("volume"), SCHEDULE.threshold(volume).alias("threshold"))


@query("i3_fill_fees", f"{_VOLUME} SELECT fill_id, {r6('CAST(qty AS DOUBLE) * CAST(price AS DOUBLE) * (' + rate_sql('volume', 'is_maker') + ')')} AS fee FROM vol")
def i3_fill_fees(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.fill_fees(_with_volume(spark, sf), SCHEDULE).select("fill_id", "fee")


# -- positions ----------------------------------------------------------------------------------

REPLAY_CTE = """numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, fill_id) AS rn,
   CAST(CASE WHEN side = 'buy' THEN qty ELSE -qty END AS DOUBLE) AS d, CAST(price AS DOUBLE) AS p, CAST(fee AS DOUBLE) AS f FROM fills),
 replay AS (
   SELECT run_id, rn, d AS q, p AS avg, -f AS pnl, false AS closing, CAST(NULL AS DOUBLE) AS trade, CAST(0 AS DOUBLE) AS q0, ts, CAST(NULL AS TIMESTAMP) AS ts0 FROM numbered WHERE rn = 1
   UNION ALL
   SELECT n.run_id, n.rn, r.q + n.d,
     CASE WHEN r.q = 0 OR (r.q > 0) = (n.d > 0) THEN (abs(r.q) * r.avg + abs(n.d) * n.p) / (abs(r.q) + abs(n.d))
          WHEN r.q + n.d = 0 THEN 0 WHEN (r.q + n.d > 0) <> (r.q > 0) THEN n.p ELSE r.avg END,
     r.pnl - n.f + CASE WHEN r.q <> 0 AND (r.q > 0) <> (n.d > 0) THEN least(abs(r.q), abs(n.d)) * (n.p - r.avg) * sign(r.q) ELSE 0 END,
     r.q <> 0 AND (r.q > 0) <> (n.d > 0),
     CASE WHEN r.q <> 0 AND (r.q > 0) <> (n.d > 0) THEN least(abs(r.q), abs(n.d)) * (n.p - r.avg) * sign(r.q) - n.f END,
     r.q, n.ts, r.ts
   FROM replay r JOIN numbered n ON n.run_id = r.run_id AND n.rn = r.rn + 1),
 positions AS (SELECT n.fill_id, n.ts, n.fee, r.* EXCLUDE (ts) FROM replay r JOIN numbered n ON n.run_id = r.run_id AND n.rn = r.rn)"""
_REPLAY = f"{_FILLS}, {REPLAY_CTE}"


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.replay(redelivered(fills(spark, sf)))


@query(
    "i1_position_replay",
    f"{_REPLAY} SELECT run_id, fill_id, {r6('q')} AS qty, {r6('avg')} AS avg_entry, {r6('pnl')} AS realized_pnl, closing AS is_closing, {r6('trade')} AS trade_pnl FROM positions",
)
def i1_position_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).select("run_id", "fill_id", F.col("qty_after").alias("qty"), "avg_entry", "realized_pnl", "is_closing", "trade_pnl")


@query("d1_total_fees", f"{_FILLS} SELECT run_id, {r6('sum(fee)')} AS total_fees, 'USDT' AS currency, count(*) AS fills FROM fills GROUP BY 1")
def d1_total_fees(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fee_totals(accounting.unique_fills(redelivered(fills(spark, sf))))


@query(
    "d2_fees_pct_of_gross",
    f"""{_REPLAY} SELECT run_id, {r6('100 * sum(fee) / nullif(abs(max_by(pnl, rn) + sum(fee)), 0)')} AS fees_pct FROM positions GROUP BY 1""",
)
def d2_fees_pct_of_gross(spark: SparkSession, sf: str) -> DataFrame:
    per_run = _positions(spark, sf).groupBy("run_id").agg(
        F.sum("fee").cast("double").alias("fees"), F.max_by("realized_pnl", F.struct("ts", "fill_id")).alias("net")
    )
    return per_run.select("run_id", metrics.fees_pct_of_gross(F.col("fees"), F.col("net")).alias("fees_pct"))


_TRADES = """count_if(closing) AS trades, count_if(closing AND trade > 0) AS wins, avg(trade) FILTER (trade > 0) AS aw, avg(trade) FILTER (trade < 0) AS al,
 avg(trade) FILTER (closing) AS ex, coalesce(sum(trade) FILTER (trade > 0), 0) AS gp, coalesce(-sum(trade) FILTER (trade < 0), 0) AS gl"""


@query(
    "d13_trade_metrics",
    f"""{_REPLAY} SELECT run_id, CAST(trades AS BIGINT) AS trades, CAST(wins AS BIGINT) AS wins, {r6('aw')} AS avg_win, {r6('al')} AS avg_loss, {r6('ex')} AS expectancy,
    {r6('wins / nullif(trades, 0)')} AS win_rate, CASE WHEN trades > 0 THEN {r6('gp / nullif(gl, 0)')} END AS profit_factor
    FROM (SELECT run_id, {_TRADES} FROM positions GROUP BY 1)""",
)
def d13_trade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.trade_metrics(_positions(spark, sf))


_SECS = "(epoch_us({b}) - epoch_us({a})) // 1000000"


@query(
    "d14_time_in_market",
    f"""{_REPLAY}, spans AS (SELECT run_id, min(ts) AS s, TIMESTAMP '2024-02-01' AS e FROM fills GROUP BY 1),
    held AS (SELECT run_id, sum(CASE WHEN q0 <> 0 THEN {_SECS.format(a='ts0', b='ts')} ELSE 0 END) AS secs, max_by(q, rn) AS q, max(ts) AS last FROM positions GROUP BY 1)
    SELECT h.run_id, {r6(f"(secs + CASE WHEN q <> 0 THEN {_SECS.format(a='last', b='e')} ELSE 0 END) / ({_SECS.format(a='s', b='e')})")} AS time_in_market
    FROM held h JOIN spans s ON s.run_id = h.run_id""",
)
def d14_time_in_market(spark: SparkSession, sf: str) -> DataFrame:
    end = F.lit("2024-02-01").cast("timestamp")
    spans = fills(spark, sf).groupBy("run_id").agg(F.min("ts").alias("_start")).select(
        "run_id", end.alias("end_ts"), (F.floor((F.unix_micros(end) - F.unix_micros("_start")) / 1_000_000) / 86_400.0).alias("total_days")
    )
    return metrics.time_in_market(_positions(spark, sf), spans)


# -- equity metrics -----------------------------------------------------------------------------

_CURVE = f"""{_EQUITY}, rets AS (SELECT *, lag(equity) OVER (PARTITION BY run_id ORDER BY ts, seq) AS b FROM equity),
 peaks AS (SELECT *, (equity - b) / b AS r, max(equity) OVER (PARTITION BY run_id ORDER BY ts, seq) AS peak FROM rets),
 dd AS (SELECT *, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS drawdown,
   ((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run_id, peak))) // 1000000) / 86400.0 AS days FROM peaks),
 m AS (SELECT run_id, count(*) AS points, min_by(equity, ts) AS s, max_by(equity, ts) AS e, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) / 86400.0 AS total_days,
   max(drawdown) AS mdd, max(days) AS ddd, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(pow(least(r - 0.00001, 0), 2)) FILTER (r IS NOT NULL)) AS down,
   sum(greatest(r - 0.00001, 0)) AS gain, sum(greatest(0.00001 - r, 0)) AS loss FROM dd GROUP BY 1),
 c AS (SELECT *, pow(e / s, 365.25 / total_days) - 1 AS cagr FROM m)"""
_RF = 0.00001


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.equity_metrics(equity(spark, sf), risk_free_rate=_RF)


@query("e14_period_returns", f"{_CURVE} SELECT run_id, seq, {r6('r')} AS period_return FROM peaks")
def e14_period_returns(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.period_returns(equity(spark, sf)).select("run_id", "seq", "period_return")


@query("e13_drawdowns", f"{_CURVE} SELECT run_id, seq, {r6('drawdown')} AS drawdown, {r6('days')} AS days_since_peak FROM dd")
def e13_drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.drawdowns(equity(spark, sf)).select("run_id", "seq", "drawdown", "days_since_peak")


@query("d8_return_cagr", f"{_CURVE} SELECT run_id, {r6('(e - s) / s')} AS total_return, {r6('cagr')} AS cagr FROM c")
def d8_return_cagr(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("run_id", "total_return", "cagr")


@query("d9_sharpe", f"{_CURVE} SELECT run_id, {r6(f'(mean - {_RF}) / nullif(sd, 0) * sqrt(252)')} AS sharpe FROM c")
def d9_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("run_id", "sharpe")


@query("d10_sortino", f"{_CURVE} SELECT run_id, {r6(f'(mean - {_RF}) / nullif(down, 0) * sqrt(252)')} AS sortino FROM c")
def d10_sortino(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("run_id", "sortino")


@query("d11_calmar", f"{_CURVE} SELECT run_id, {r6('cagr / nullif(mdd, 0)')} AS calmar, {r6('mdd')} AS max_drawdown, {r6('ddd')} AS drawdown_duration_days FROM c")
def d11_calmar(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("run_id", "calmar", "max_drawdown", "drawdown_duration_days")


@query("d12_omega", f"{_CURVE} SELECT run_id, {r6('gain / nullif(loss, 0)')} AS omega FROM c")
def d12_omega(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("run_id", "omega")


# -- funding ------------------------------------------------------------------------------------


@query(
    "e17_funding",
    f"""WITH o AS (SELECT user_id AS position_id, event_id AS obs_id, ts, TIMESTAMP '2024-01-01 03:00:00' AS opened, value AS mark,
      CASE WHEN event_type = 'view' THEN -2 ELSE 3 END AS qty FROM events),
    k AS (SELECT *, greatest(CAST(floor((epoch_us(ts) - epoch_us(opened)) / 28800000000) AS BIGINT), 0) AS k FROM o),
    p AS (SELECT *, coalesce(max(k) OVER (PARTITION BY position_id ORDER BY ts, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paid FROM k)
    SELECT position_id, epoch_us(opened) + b * 28800000000 AS accrued_at, {r6('-(qty * mark * 0.0001)')} AS amount
    FROM (SELECT *, unnest(generate_series(paid + 1, k)) AS b FROM p WHERE k > paid)""",
)
def e17_funding(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select(
        F.col("user_id").alias("position_id"), F.col("event_id").alias("obs_id"), "ts", F.lit("2024-01-01 03:00:00").cast("timestamp").alias("opened_at"),
        F.col("value").cast(MONEY).alias("mark_price"), F.when(F.col("event_type") == "view", -2).otherwise(3).cast(MONEY).alias("qty"), F.lit(0.0001).alias("funding_rate"),
    )
    return accounting.funding_payments(seen)


@query(
    "e16_sequence_gaps",
    """WITH m AS (SELECT event_type AS stream, event_id AS arrival, event_id // 3 AS seq FROM events)
    SELECT stream, arrival, previous_sequence, seq AS received_sequence FROM (SELECT *, lag(seq) OVER (PARTITION BY stream ORDER BY arrival) AS previous_sequence FROM m)
    WHERE seq <> previous_sequence + 1""",
)
def e16_sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    messages = table(spark, sf, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("arrival"), F.expr("event_id div 3").alias("seq"))
    return accounting.sequence_gaps(messages)


# -- execution ----------------------------------------------------------------------------------

_BARW = "PARTITION BY instrument_id ORDER BY open_time"
_EXEC = f"""{WITH_CANDLES}, nxt AS (SELECT *, lag(open_time) OVER ({_BARW}) AS signal_time FROM candles),
 asks AS (SELECT event_id AS order_id, event_type AS instrument_id, date_trunc('hour', ts) AS signal_time, user_id,
   CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(1 + event_id % 40 + CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(18,8)) AS qty,
   CAST(CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(18,8)) AS filled, value % 2 < 1 AS is_maker, (event_id * 7) % 3000 AS vol FROM events),
 j AS (SELECT a.*, n.open_time, n.open, n.volume, qty - filled AS rem FROM asks a JOIN nxt n ON n.instrument_id = a.instrument_id AND n.signal_time = a.signal_time),
 s AS (SELECT *, least(rem, CAST(volume * 0.5 AS DECIMAL(18,8))) AS can, CASE WHEN volume > 0 THEN CAST(rem AS DOUBLE) / CAST(volume AS DOUBLE) ELSE 0 END AS share FROM j),
 p AS (SELECT *, CAST(open + (CASE WHEN side = 'buy' THEN 1 ELSE -1 END) * CAST(0.02 / 2 + share * 0.3 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS price FROM s),
 v AS (SELECT *, CAST(can AS DECIMAL(19,8)) * price AS notional FROM p),
 o AS (SELECT *, CASE WHEN rem % 0.5 <> 0 OR (rem * 2) % 2 <> 0 THEN 'precision' WHEN can <= 0 THEN 'no_fill' WHEN notional < 20 THEN 'min_notional' WHEN notional > 1500 THEN 'insufficient_margin'
   WHEN can < rem THEN 'partially_filled' ELSE 'filled' END AS outcome FROM v)"""


def order_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an order, joined with the bar they may execute on."""
    i, amount = F.col("event_id"), lambda c: c.cast(MONEY)
    asks = table(spark, sf, "events").select(
        i.alias("order_id"), F.col("event_type").alias("instrument_id"), F.lit("1h").alias("interval"), F.date_trunc("hour", "ts").alias("signal_time"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        amount(1 + i % 40 + F.when(i % 11 == 0, F.lit(0.5)).otherwise(0.0)).alias("qty"),
        amount(F.when(i % 5 == 0, F.lit(0.5)).otherwise(0.0)).alias("filled_qty"),
        amount(F.lit(1)).alias("lot_size"), amount(F.lit(20)).alias("min_notional"), F.lit(0.02).alias("spread"), F.lit(0.3).alias("volatility"),
        amount(F.lit(1500)).alias("available_balance"), F.lit("USDT").alias("balance_currency"), F.lit("USDT").alias("quote_currency"),
        (F.col("value") % 2 < 1).alias("is_maker"), ((i * 7) % 3000).alias("thirty_day_volume"),
    )
    return asof.join_next_bar(asks, candles(spark, sf))


@query(
    "i2_evaluate_orders",
    f"""{_EXEC} SELECT order_id, outcome, {r6("CASE WHEN outcome IN ('filled','partially_filled') THEN can END")} AS fill_qty,
    {r6("CASE WHEN outcome IN ('filled','partially_filled') THEN price END")} AS fill_price,
    {r6("CASE WHEN outcome IN ('filled','partially_filled') THEN CAST(notional AS DOUBLE) * (" + rate_sql('vol', 'is_maker') + ") END")} AS fee,
    CASE WHEN outcome IN ('filled','partially_filled') THEN epoch_us(open_time) + 2000000 END AS fill_ts,
    {r6("CASE WHEN outcome IN ('filled','partially_filled') THEN rem - can ELSE rem END")} AS remaining_qty FROM o""",
)
def i2_evaluate_orders(spark: SparkSession, sf: str) -> DataFrame:
    done = execution.evaluate_orders(order_requests(spark, sf), SCHEDULE, max_volume_fraction=Decimal("0.5"), latency_seconds=2)
    return done.select("order_id", "outcome", "fill_qty", "fill_price", "fee", "fill_ts", "remaining_qty")


_QUEUE = f"""{WITH_CANDLES}, asks AS (SELECT event_id AS order_id, event_type AS instrument_id, ts AS placed_at, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
   CAST(1 + event_id % 40 + CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(18,8)) - CAST(CASE WHEN event_id % 22 = 0 THEN 0.5 WHEN event_id % 5 = 0 AND event_id % 11 <> 0 THEN 1 ELSE 0 END AS DECIMAL(18,8)) AS need,
   value % 2 < 1 AS is_maker, (event_id * 7) % 3000 AS vol FROM events),
 queued AS (SELECT *, sum(need) OVER (PARTITION BY instrument_id ORDER BY placed_at, order_id) AS upto FROM asks WHERE need > 0 AND (need * 2) % 2 = 0),
 room AS (SELECT instrument_id, open_time, open, volume, CAST(volume * 0.25 AS DECIMAL(18,8)) AS c, row_number() OVER (PARTITION BY instrument_id ORDER BY open_time) AS t,
   (SELECT coalesce(sum(need), 0) FROM queued q WHERE q.instrument_id = b.instrument_id AND q.placed_at < b.open_time) AS a FROM candles b WHERE volume > 0),
 walk AS (SELECT instrument_id, t, CAST(0 AS DECIMAL(28,8)) AS before, CAST(least(a, c) AS DECIMAL(28,8)) AS d FROM room WHERE t = 1
   UNION ALL SELECT r.instrument_id, r.t, w.d, CAST(least(r.a, w.d + r.c) AS DECIMAL(28,8)) FROM walk w JOIN room r ON r.instrument_id = w.instrument_id AND r.t = w.t + 1),
 met AS (SELECT q.order_id, r.*, q.side, q.is_maker, q.vol, q.upto, least(w.d, q.upto) - greatest(w.before, q.upto - q.need) AS qty, q.upto - greatest(w.before, q.upto - q.need) AS rest
   FROM walk w JOIN room r ON r.instrument_id = w.instrument_id AND r.t = w.t JOIN queued q ON q.instrument_id = w.instrument_id AND w.d > q.upto - q.need AND w.before < q.upto AND w.d > w.before),
 dealt AS (SELECT *, CAST(open + (CASE WHEN side = 'buy' THEN 1 ELSE -1 END) * CAST(0.02 / 2 + CAST(rest AS DOUBLE) / CAST(volume AS DOUBLE) * 0.3 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS price FROM met)"""


def resting_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an order that stays open in the queue of its type."""
    i, amount = F.col("event_id"), lambda c: c.cast(MONEY)
    half, some = (i % 11 == 0), F.when(i % 22 == 0, 0.5).when((i % 5 == 0) & (i % 11 != 0), 1.0).otherwise(0.0)
    return table(spark, sf, "events").select(
        i.alias("order_id"), F.col("event_type").alias("instrument_id"), F.lit("1h").alias("interval"), F.col("ts").alias("placed_at"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), amount(1 + i % 40 + F.when(half, F.lit(0.5)).otherwise(0.0)).alias("qty"), amount(some).alias("filled_qty"),
        amount(F.lit(1)).alias("lot_size"), F.lit(0.02).alias("spread"), F.lit(0.3).alias("volatility"), (F.col("value") % 2 < 1).alias("is_maker"), ((i * 7) % 3000).alias("thirty_day_volume"),
    )


def _resting(spark: SparkSession, sf: str) -> DataFrame:
    return resting.resting_fills(resting_orders(spark, sf), candles(spark, sf), SCHEDULE, max_volume_fraction=Decimal("0.25"), latency_seconds=2)


@query(
    "i2_resting_orders",
    f"""{_QUEUE} SELECT order_id, epoch_us(open_time) + 2000000 AS fill_ts, {r6('qty')} AS fill_qty, {r6('price')} AS fill_price,
    {r6("CAST(CAST(qty AS DECIMAL(19,8)) * price AS DOUBLE) * (" + rate_sql('vol', 'is_maker') + ")")} AS fee, {r6('rest - qty')} AS remaining_qty FROM dealt""",
)
def i2_resting_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Fills of orders that wait for as many bars as they need."""
    return _resting(spark, sf).select("order_id", "fill_ts", "fill_qty", "fill_price", "fee", "remaining_qty")


@query(
    "i2_resting_outcomes",
    f"""{_QUEUE}, sums AS (SELECT order_id, sum(qty) AS qty, count(*) AS bars FROM dealt GROUP BY 1)
    SELECT a.order_id, CASE WHEN need <= 0 THEN 'invalid' WHEN (need * 2) % 2 <> 0 THEN 'precision' WHEN coalesce(s.qty, 0) = need THEN 'filled' WHEN s.qty > 0 THEN 'partially_filled' ELSE 'open' END AS outcome,
    {r6('coalesce(s.qty, 0)')} AS fill_qty, coalesce(bars, 0) AS bars, {r6('need - coalesce(s.qty, 0)')} AS remaining_qty FROM asks a LEFT JOIN sums s ON s.order_id = a.order_id""",
)
def i2_resting_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    done = resting.resting_outcomes(resting_orders(spark, sf), _resting(spark, sf))
    return done.select("order_id", "outcome", "fill_qty", "bars", "remaining_qty")


# -- order events -------------------------------------------------------------------------------

_ORDER_EVENTS = """SELECT event_id // 4 AS order_id, event_id % 4 + 1 + CASE WHEN event_id % 61 = 0 THEN 1 ELSE 0 END AS seq, ts, event_id,
 CASE event_id % 4 WHEN 0 THEN CASE WHEN value < 3 THEN 'sent' ELSE 'created' END WHEN 1 THEN 'sent' WHEN 2 THEN CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'acked' END
   ELSE CASE event_type WHEN 'click' THEN 'filled' WHEN 'view' THEN 'partially_filled' WHEN 'error' THEN 'cancel_requested' WHEN 'purchase' THEN 'expired' ELSE 'adopted' END END AS event_type FROM events"""
_LEGAL = """(VALUES ('pending_new','sent'),('sent','acked'),('sent','rejected'),('sent','unknown'),('acked','partially_filled'),('acked','filled'),('acked','pending_cancel'),('acked','expired'),
 ('partially_filled','partially_filled'),('partially_filled','filled'),('partially_filled','pending_cancel'),('partially_filled','expired'),('pending_cancel','canceled'),('pending_cancel','filled'),('pending_cancel','partially_filled'))"""
_STATUS = "CASE {c} WHEN 'created' THEN 'pending_new' WHEN 'cancel_requested' THEN 'pending_cancel' WHEN 'adopted' THEN NULL ELSE {c} END"


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of four events per order, legal and illegal."""
    i, kind = F.col("event_id"), F.col("event_type")
    last = F.when(kind == "click", "filled").when(kind == "view", "partially_filled").when(kind == "error", "cancel_requested").when(kind == "purchase", "expired").otherwise("adopted")
    step = (
        F.when(i % 4 == 0, F.when(F.col("value") < 3, "sent").otherwise("created"))
        .when(i % 4 == 1, "sent")
        .when(i % 4 == 2, F.when(kind == "error", "rejected").otherwise("acked"))
        .otherwise(last)
    )
    return table(spark, sf, "events").select(
        F.expr("event_id div 4").alias("order_id"), (i % 4 + 1 + F.when(i % 61 == 0, 1).otherwise(0)).alias("seq"), "ts", "event_id", step.alias("event_type")
    )


@query(
    "i4_order_states",
    f"""WITH e AS ({_ORDER_EVENTS}), n AS (SELECT *, row_number() OVER w AS rn, lag(event_type) OVER w AS pe FROM e WINDOW w AS (PARTITION BY order_id ORDER BY seq, ts, event_id)),
    st AS (SELECT *, {_STATUS.format(c='event_type')} AS status, {_STATUS.format(c='pe')} AS before FROM n),
    pr AS (SELECT *, CASE WHEN rn = 1 AND event_type <> 'created' THEN 'first event is ' || event_type
      WHEN seq <> rn THEN 'expected seq ' || rn || ', got ' || seq
      WHEN rn > 1 AND (event_type = 'created' OR status IS NULL) THEN 'illegal event ' || event_type
      WHEN rn > 1 AND (before, status) NOT IN (SELECT * FROM {_LEGAL}) THEN 'illegal transition ' || before || ' to ' || status END AS problem FROM st)
    SELECT order_id, count(*) AS events, min_by(problem, rn) FILTER (problem IS NOT NULL) AS problem,
      CASE WHEN count(problem) = 0 THEN max_by(status, rn) END AS status FROM pr GROUP BY 1""",
)
def i4_order_states(spark: SparkSession, sf: str) -> DataFrame:
    return orders.order_states(order_events(spark, sf)).select("order_id", "events", "problem", "status")


# -- backtests ----------------------------------------------------------------------------------

_RUNS = f"""{WITH_CANDLES}, bars AS (SELECT c.instrument_id || '-' || e.every AS run_id, e.every, c.* FROM candles c, (VALUES (8), (12)) e(every)),
 numbered_bars AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY open_time) - 1 AS i FROM bars),
 sigs AS (SELECT *, CASE WHEN i % every = 0 THEN CASE WHEN (i // every) % 2 = 0 THEN 'buy' ELSE 'sell' END END AS signal, i < 5 AS warm FROM numbered_bars),
 nextbar AS (SELECT *, lag(signal) OVER w AS ps, lag(warm) OVER w AS pw, lag(open_time) OVER w AS pt FROM sigs WINDOW w AS (PARTITION BY run_id ORDER BY open_time)),
 fills AS (SELECT run_id, epoch_us(pt) AS fill_id, open_time AS ts, ps AS side, CAST(1 AS DECIMAL(18,8)) AS qty, open AS price, CAST(open AS DOUBLE) * 0.001 AS fee FROM nextbar WHERE ps IS NOT NULL AND NOT pw)"""
_MARKED = f"""{_RUNS}, {REPLAY_CTE},
 changes AS (SELECT run_id, ts AS moment, 0 AS kind, struct_pack(q := q, a := avg, p := pnl) AS st, CAST(NULL AS DOUBLE) AS close FROM positions
   UNION ALL SELECT run_id, open_time, 1, NULL, CAST(close AS DOUBLE) FROM bars),
 held AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY moment, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM changes),
 equity AS (SELECT run_id, moment AS ts, 100000 + coalesce(h.p, 0) + CASE WHEN coalesce(h.q, 0) <> 0 THEN h.q * (close - h.a) ELSE 0 END AS equity FROM held WHERE kind = 1)"""


def run_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs per instrument: toggling every 8 and every 12 bars."""
    bars = candles(spark, sf).withColumn("every", F.explode(F.array(F.lit(8), F.lit(12))))
    return bars.withColumn("run_id", F.concat_ws("-", "instrument_id", F.col("every").cast("string")))


_RULE = jobs.toggle_rule("every")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.signals(run_bars(spark, sf), _RULE, 5)


@query("e15_warmup_gate", f"{_RUNS} SELECT run_id, epoch_us(open_time) AS open_time, signal FROM sigs WHERE NOT warm AND signal IS NOT NULL")
def e15_warmup_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).where(~F.col("in_warmup") & F.col("signal").isNotNull()).select("run_id", "open_time", "signal")


@query(
    "d16_run_counters",
    f"""{_RUNS} SELECT run_id, count(*) AS bars_processed, CAST(count_if(NOT warm) AS BIGINT) AS signal_opportunities, CAST(count_if(NOT warm AND signal IS NOT NULL) AS BIGINT) AS signals_produced,
    CAST(count_if(warm AND signal IS NOT NULL) AS BIGINT) AS signals_discarded_during_warmup FROM sigs GROUP BY 1""",
)
def d16_run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.run_counters(_signals(spark, sf))


@query(
    "k6_custom_signal_rule",
    f"""{_RUNS}, crossed AS (SELECT run_id, open_time, i, close, avg(CAST(close AS DOUBLE)) OVER (PARTITION BY run_id ORDER BY open_time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM sigs)
    SELECT run_id, epoch_us(open_time) AS open_time, CASE WHEN CAST(close AS DOUBLE) > m THEN 'buy' ELSE 'sell' END AS signal FROM crossed WHERE i >= 20""",
)
def k6_custom_signal_rule(spark: SparkSession, sf: str) -> DataFrame:
    line = Series(("run_id",), ("open_time",), width=30 * 86_400)
    close = F.col("close").cast("double")

    def above_mean(bars: DataFrame) -> DataFrame:
        means = line.rolling(bars, 9, lambda w: {"m": F.avg(close).over(w.rowsBetween(-9, 0))})
        return means.withColumn("signal", F.when(close > F.col("m"), "buy").otherwise("sell"))

    signalled = jobs.signals(run_bars(spark, sf), above_mean, 20)
    return signalled.where(~F.col("in_warmup")).select("run_id", "open_time", "signal")


_BAND = f"""{_RUNS}, line AS (SELECT run_id, open_time, i + 1 AS n, CAST(open AS DOUBLE) AS o, CAST(close AS DOUBLE) AS c FROM sigs),
 held AS (SELECT run_id, n, 0 AS before, CAST(NULL AS DOUBLE) AS entry, CASE WHEN c > 70 AND n > 5 THEN 1 ELSE 0 END AS after, CASE WHEN c > 70 AND n > 5 THEN 'buy' END AS signal, CAST(NULL AS VARCHAR) AS cause FROM line WHERE n = 1
   UNION ALL SELECT l.run_id, l.n, h.after, CASE h.after WHEN 1 THEN l.o WHEN 2 THEN h.entry END,
     CASE WHEN h.after = 0 THEN CASE WHEN l.c > 70 AND l.n > 5 THEN 1 ELSE 0 END WHEN l.c < 30 OR l.c <= 0.8::DOUBLE * (CASE h.after WHEN 1 THEN l.o ELSE h.entry END) THEN 0 ELSE 2 END,
     CASE WHEN h.after = 0 THEN CASE WHEN l.c > 70 AND l.n > 5 THEN 'buy' END WHEN l.c < 30 OR l.c <= 0.8::DOUBLE * (CASE h.after WHEN 1 THEN l.o ELSE h.entry END) THEN 'sell' END,
     CASE WHEN h.after = 0 THEN NULL WHEN l.c < 30 THEN 'rule' WHEN l.c <= 0.8::DOUBLE * (CASE h.after WHEN 1 THEN l.o ELSE h.entry END) THEN 'stop' END
   FROM held h JOIN line l ON l.run_id = h.run_id AND l.n = h.n + 1)"""


@query(
    "k6_stateful_rule",
    f"""{_BAND} SELECT h.run_id, epoch_us(l.open_time) AS open_time, signal, {r6('entry')} AS entry, cause FROM held h JOIN line l ON l.run_id = h.run_id AND l.n = h.n WHERE signal IS NOT NULL OR entry IS NOT NULL""",
)
def k6_stateful_rule(spark: SparkSession, sf: str) -> DataFrame:
    """In above 70, out below 30 or a fifth below the price the entry was filled at."""
    close = F.col("close").cast("double")
    signalled = jobs.signals(run_bars(spark, sf), rules.band_rule(close > 70, close < 30, 0.8, warmup=5), 5)
    return signalled.where("signal IS NOT NULL OR entry IS NOT NULL").select("run_id", "open_time", "signal", "entry", "cause")


@query("e18_equity_curve", f"{_MARKED} SELECT run_id, epoch_us(ts) AS ts, {r6('equity')} AS equity FROM equity")
def e18_equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.backtest(run_bars(spark, sf), _RULE, 5)["equity"].select("run_id", "ts", "equity")


_SHEET = f"""{_MARKED}, rets AS (SELECT *, lag(equity) OVER w AS b, max(equity) OVER w AS peak FROM equity WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
 dd AS (SELECT *, (equity - b) / b AS r, (peak - equity) / peak AS drawdown, ((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run_id, peak))) // 1000000) / 86400.0 AS days FROM rets),
 m AS (SELECT run_id, min_by(equity, ts) AS s, max_by(equity, ts) AS e, max(ts) AS end_ts, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) / 86400.0 AS total_days, max(drawdown) AS mdd, max(days) AS ddd,
   avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2)) FILTER (r IS NOT NULL)) AS down, sum(greatest(r, 0)) AS gain, sum(greatest(-r, 0)) AS loss FROM dd GROUP BY 1),
 t AS (SELECT run_id, sum(fee) AS fees, {_TRADES}, sum(CASE WHEN q0 <> 0 THEN {_SECS.format(a='ts0', b='ts')} ELSE 0 END) AS secs, max_by(q, rn) AS q, max(ts) AS last FROM positions GROUP BY 1),
 sheet AS (SELECT m.run_id, (e - s) / s AS total_return, pow(e / s, 365.25 / total_days) - 1 AS cagr, mdd, ddd, mean / nullif(sd, 0) * sqrt(252) AS sharpe, mean / nullif(down, 0) * sqrt(252) AS sortino,
   gain / nullif(loss, 0) AS omega, wins / nullif(trades, 0) AS win_rate, gp / nullif(gl, 0) AS profit_factor, aw, al, ex,
   (secs + CASE WHEN q <> 0 THEN {_SECS.format(a='last', b='end_ts')} ELSE 0 END) / 86400.0 / total_days AS tim, fees, 100 * fees / nullif(abs(e - s + fees), 0) AS pct FROM m JOIN t ON t.run_id = m.run_id)"""


@query(
    "k4_backtest_tearsheet",
    f"""{_SHEET} SELECT run_id, {r6('total_return')} AS total_return, {r6('cagr')} AS cagr, {r6('mdd')} AS max_drawdown, {r6('ddd')} AS drawdown_duration_days, {r6('sharpe')} AS sharpe, {r6('sortino')} AS sortino,
    {r6('omega')} AS omega, {r6('win_rate')} AS win_rate, {r6('profit_factor')} AS profit_factor, {r6('aw')} AS avg_win, {r6('al')} AS avg_loss, {r6('ex')} AS expectancy,
    {r6('tim')} AS time_in_market, {r6('fees')} AS total_fees, {r6('pct')} AS fees_pct_of_gross, {r6('cagr / nullif(mdd, 0)')} AS calmar, 'USDT' AS currency, CAST(NULL AS VARCHAR) AS problem FROM sheet""",
)
def k4_backtest_tearsheet(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.backtest(run_bars(spark, sf), _RULE, 5)["tearsheet"].drop("slippage")


_SHEET_FIGURES = ", ".join(
    f"{r6(sql)} AS {name}"
    for name, sql in {
        "total_return": "total_return", "cagr": "cagr", "max_drawdown": "mdd", "drawdown_duration_days": "ddd", "sharpe": "sharpe", "sortino": "sortino",
        "calmar": "cagr / nullif(mdd, 0)", "omega": "omega", "win_rate": "win_rate", "profit_factor": "profit_factor", "avg_win": "aw", "avg_loss": "al",
        "expectancy": "ex", "time_in_market": "tim", "total_fees": "fees", "fees_pct_of_gross": "pct",
    }.items()
)


@query(
    "d15_tearsheet_json",
    f"""{_SHEET} SELECT run_id, {_SHEET_FIGURES}, true AS slippage_is_null, 'USDT' AS currency FROM sheet""",
)
def d15_tearsheet_json(spark: SparkSession, sf: str) -> DataFrame:
    text = metrics.tearsheet_json(jobs.backtest(run_bars(spark, sf), _RULE, 5)["tearsheet"])
    field = lambda name: F.get_json_object("tearsheet", f"$.{name}")
    return text.select(
        "run_id", *[field(name).cast("double").alias(name) for name in metrics.TEARSHEET if name not in ("slippage", "currency")],
        (field("slippage").isNull() & F.col("tearsheet").contains('"slippage":null')).alias("slippage_is_null"), field("currency").alias("currency"),
    )


_PLAIN_FILLS = _RUNS[_RUNS.index(" fills AS (") :]
_TIERED_FILLS = f""" orders AS (SELECT run_id, pt, open_time, ps AS side, open, volume, least(CAST(1 AS DECIMAL(18,8)), CAST(volume * 0.5 AS DECIMAL(18,8))) AS can,
   CASE WHEN volume > 0 THEN 1.0 / CAST(volume AS DOUBLE) ELSE 0 END AS share FROM nextbar WHERE ps IS NOT NULL AND NOT pw),
 priced AS (SELECT *, CAST(open + (CASE WHEN side = 'buy' THEN 1 ELSE -1 END) * CAST(0.02 / 2 + share * 0.3 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS price FROM orders WHERE can > 0),
 traded AS (SELECT *, sum(CAST(can AS DOUBLE) * CAST(price AS DOUBLE)) OVER (PARTITION BY run_id ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM priced WHERE CAST(can AS DECIMAL(19,8)) * price >= 20),
 fills AS (SELECT run_id, epoch_us(pt) AS fill_id, open_time AS ts, side, can AS qty, price,
   CAST(can AS DOUBLE) * CAST(price AS DOUBLE) * ({rate_sql('coalesce(before, 0)', 'false')}) AS fee, CAST(abs(price - open) AS DOUBLE) * CAST(can AS DOUBLE) AS slip FROM traded)"""


@query(
    "k4_tiered_slippage",
    f"""{_SHEET.replace(_PLAIN_FILLS, _TIERED_FILLS)} SELECT sheet.run_id, {r6('total_return')} AS total_return, {r6('fees')} AS total_fees, {r6('pct')} AS fees_pct_of_gross, {r6('ex')} AS expectancy,
    {r6('slippage')} AS slippage FROM sheet JOIN (SELECT run_id, sum(slip) AS slippage FROM fills GROUP BY 1) s ON s.run_id = sheet.run_id""",
)
def k4_tiered_slippage(spark: SparkSession, sf: str) -> DataFrame:
    """The same runs with fee tiers, slippage, half of a bar's volume at most and a least notional."""
    how = jobs.Execution(SCHEDULE, max_volume_fraction=Decimal("0.5"), spread=0.02, volatility=0.3, min_notional=Decimal(20))
    sheet = jobs.backtest(run_bars(spark, sf), _RULE, 5, how=how)["tearsheet"]
    return sheet.where("problem is null").select("run_id", "total_return", "total_fees", "fees_pct_of_gross", "expectancy", "slippage")


# -- runs over several instruments --------------------------------------------------------------

_DESK = "CASE WHEN instrument_id IN ('click', 'view') THEN 'pages' WHEN instrument_id IN ('purchase', 'signup') THEN 'users' ELSE 'other' END || '-' || every"
_FOLIO = f"""{_MARKED}, books AS (SELECT DISTINCT run_id AS book_id, {_DESK} AS desk FROM bars),
 line AS (SELECT DISTINCT desk, ts FROM equity JOIN books ON run_id = book_id),
 folio AS (SELECT p.desk AS run_id, p.ts, 100000 + sum(coalesce(e.equity - 100000, 0)) AS equity
   FROM (SELECT l.desk, l.ts, book_id FROM line l JOIN books b ON b.desk = l.desk) p ASOF LEFT JOIN equity e ON e.run_id = p.book_id AND e.ts <= p.ts GROUP BY 1, 2)"""


def desk_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two instruments each (the rest of them in one more), toggling every 8 and every 12 bars of an instrument."""
    name = F.col("instrument_id")
    desk = F.when(name.isin("click", "view"), "pages").when(name.isin("purchase", "signup"), "users").otherwise("other")
    return run_bars(spark, sf).withColumn("run_id", F.concat_ws("-", desk, F.col("every").cast("string")))


@query("e18_portfolio_curve", f"{_FOLIO} SELECT run_id, epoch_us(ts) AS ts, {r6('equity')} AS equity FROM folio")
def e18_portfolio_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Equity at every time one of a run's instruments has a bar; the others keep their last close."""
    return jobs.backtest(desk_bars(spark, sf), _RULE, 5, book="instrument_id")["equity"].select("run_id", "ts", "equity")


@query(
    "k4_two_symbols",
    f"""{_FOLIO}, rets AS (SELECT *, lag(equity) OVER w AS b, max(equity) OVER w AS peak FROM folio WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
 dd AS (SELECT *, (equity - b) / b AS r, (peak - equity) / peak AS drawdown FROM rets),
 m AS (SELECT run_id, min_by(equity, ts) AS s, max_by(equity, ts) AS e, max(ts) AS end_ts, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) / 86400.0 AS total_days, max(drawdown) AS mdd, avg(r) AS mean, stddev_samp(r) AS sd FROM dd GROUP BY 1),
 traded AS (SELECT desk, p.* FROM positions p JOIN books ON p.run_id = book_id),
 t AS (SELECT desk, sum(fee) AS fees, {_TRADES} FROM traded GROUP BY 1),
 steps AS (SELECT desk, ts, sum(CAST(q <> 0 AS INT) - CAST(q0 <> 0 AS INT)) AS step FROM traded GROUP BY 1, 2),
 open_books AS (SELECT desk, ts, sum(step) OVER (PARTITION BY desk ORDER BY ts) AS n, lead(ts) OVER (PARTITION BY desk ORDER BY ts) AS upto FROM steps),
 spans AS (SELECT desk, sum(CASE WHEN n > 0 THEN {_SECS.format(a='ts', b='coalesce(upto, end_ts)')} ELSE 0 END) AS secs FROM open_books JOIN m ON run_id = desk GROUP BY 1)
 SELECT m.run_id, {r6('(e - s) / s')} AS total_return, {r6('mdd')} AS max_drawdown, {r6('mean / nullif(sd, 0) * sqrt(252)')} AS sharpe, {r6('wins / nullif(trades, 0)')} AS win_rate, {r6('ex')} AS expectancy,
   {r6('secs / 86400.0 / total_days')} AS time_in_market, {r6('fees')} AS total_fees, {r6('100 * fees / nullif(abs(e - s + fees), 0)')} AS fees_pct_of_gross
 FROM m JOIN t ON t.desk = m.run_id JOIN spans ON spans.desk = m.run_id""",
)
def k4_two_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Tearsheets of runs over several instruments."""
    sheet = jobs.backtest(desk_bars(spark, sf), _RULE, 5, book="instrument_id")["tearsheet"]
    return sheet.select("run_id", "total_return", "max_drawdown", "sharpe", "win_rate", "expectancy", "time_in_market", "total_fees", "fees_pct_of_gross")
