"""Ordered-series queries: indicators, quality checks, gaps, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import (
    WITH_CANDLES,
    WITH_DIRTY,
    WITH_M15,
    candles,
    dirty,
    query,
    r6,
    table,
    us,
)
from tidemark.operators import asof, gaps, indicators, quality
from tidemark.functions import intervals
from tidemark.plans.jobs import staged
from tidemark.session import scratch

_AT = f"instrument_id, {us('open_time')} AS open_time"
_W = "PARTITION BY instrument_id ORDER BY open_time"


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("instrument_id", "open_time", *columns)


# -- indicators ---------------------------------------------------------------------------------


@query(
    "e1_sma",
    f"""{WITH_CANDLES} SELECT {_AT}, CASE WHEN count(*) OVER w = 20 THEN {r6('avg(CAST(close AS DOUBLE)) OVER w')} END AS sma
    FROM candles WINDOW w AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def e1_sma(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(indicators.sma(candles(spark, sf), 20), "sma")


def ema_cte(name: str, source: str, value: str, span: int) -> str:
    """A recursive CTE: ``name`` (instrument_id, rn, y) over ``source`` (instrument_id, rn, value)."""
    a = 2.0 / (span + 1)
    return f"""{name} AS (
      SELECT instrument_id, rn, CAST({value} AS DOUBLE) AS y FROM {source} WHERE rn = 1
      UNION ALL
      SELECT s.instrument_id, s.rn, p.y + {a!r} * (CAST(s.{value} AS DOUBLE) - p.y)
      FROM {name} p JOIN {source} s ON s.instrument_id = p.instrument_id AND s.rn = p.rn + 1)"""


_NUMBERED = f"{WITH_CANDLES}, numbered AS (SELECT *, row_number() OVER ({_W}) AS rn FROM candles)"


@query(
    "e2_ema",
    f"""{_NUMBERED}, {ema_cte('smooth', 'numbered', 'close', 12)}
    SELECT n.instrument_id, {us('n.open_time')} AS open_time, {r6('y')} AS ema
    FROM numbered n JOIN smooth s ON s.instrument_id = n.instrument_id AND s.rn = n.rn""",
)
def e2_ema(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(indicators.ema(candles(spark, sf), 12), "ema")


@query(
    "e3_rsi",
    f"""{WITH_CANDLES}, moves AS (SELECT *, coalesce(CAST(close AS DOUBLE) - lag(CAST(close AS DOUBLE)) OVER ({_W}), 0) AS d FROM candles),
    means AS (SELECT instrument_id, open_time, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS l, count(*) OVER w AS n
      FROM moves WINDOW w AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT {_AT}, CASE WHEN n < 14 THEN NULL WHEN g + l = 0 THEN 50.0 ELSE {r6('100 * g / (g + l)')} END AS rsi FROM means""",
)
def e3_rsi(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(indicators.rsi(candles(spark, sf)), "rsi")


@query(
    "e4_atr",
    f"""{WITH_CANDLES}, d AS (SELECT instrument_id, open_time, CAST(high AS DOUBLE) AS h, CAST(low AS DOUBLE) AS l, lag(CAST(close AS DOUBLE)) OVER ({_W}) AS c FROM candles),
    tr AS (SELECT *, greatest(h - l, coalesce(abs(h - c), 0), coalesce(abs(l - c), 0)) AS r FROM d)
    SELECT {_AT}, CASE WHEN count(*) OVER w = 14 THEN {r6('avg(r) OVER w')} END AS atr
    FROM tr WINDOW w AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
)
def e4_atr(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(indicators.atr(candles(spark, sf)), "atr")


@query(
    "e5_bollinger",
    f"""{WITH_CANDLES}, s AS (SELECT instrument_id, open_time, count(*) OVER w AS n, avg(CAST(close AS DOUBLE)) OVER w AS m, stddev_samp(CAST(close AS DOUBLE)) OVER w AS d
      FROM candles WINDOW w AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT {_AT}, CASE WHEN n = 20 THEN {r6('m + 2 * d')} END AS bb_upper, CASE WHEN n = 20 THEN {r6('m')} END AS bb_middle,
      CASE WHEN n = 20 THEN {r6('m - 2 * d')} END AS bb_lower FROM s""",
)
def e5_bollinger(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(indicators.bollinger(candles(spark, sf)), "bb_upper", "bb_middle", "bb_lower")


@query(
    "e6_macd",
    f"""{_NUMBERED}, {ema_cte('fast', 'numbered', 'close', 12)}, {ema_cte('slow', 'numbered', 'close', 26)},
    line AS (SELECT f.instrument_id, f.rn, f.y - s.y AS m FROM fast f JOIN slow s ON s.instrument_id = f.instrument_id AND s.rn = f.rn),
    {ema_cte('sig', 'line', 'm', 9)}
    SELECT n.instrument_id, {us('n.open_time')} AS open_time, {r6('m')} AS macd, {r6('y')} AS macd_signal, {r6('m - y')} AS macd_hist
    FROM numbered n JOIN line l ON l.instrument_id = n.instrument_id AND l.rn = n.rn
    JOIN sig s ON s.instrument_id = n.instrument_id AND s.rn = n.rn""",
)
def e6_macd(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(indicators.macd(candles(spark, sf)), "macd", "macd_signal", "macd_hist")


@query(
    "e7_rolling_volatility",
    f"""{WITH_CANDLES}, p AS (SELECT instrument_id, open_time, CAST(close AS DOUBLE) AS c, lag(CAST(close AS DOUBLE)) OVER ({_W}) AS b, row_number() OVER ({_W}) AS rn FROM candles),
    r AS (SELECT *, CASE WHEN rn = 1 THEN 0.0 WHEN b = 0 THEN NULL ELSE (c - b) / b END AS ret FROM p)
    SELECT {_AT}, CASE WHEN rn >= 20 THEN {r6('stddev_samp(ret) OVER w * sqrt(252)')} END AS volatility
    FROM r WINDOW w AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def e7_rolling_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(indicators.rolling_volatility(candles(spark, sf), 20), "volatility")


# -- structural quality -------------------------------------------------------------------------

_CHECKS_SQL = f"""{WITH_DIRTY}, checks AS (
 SELECT instrument_id, open_time, arrival, 'ohlc_invariant' AS check_name FROM dirty WHERE high < greatest(open, close) OR low > least(open, close) OR high < low
 UNION ALL SELECT instrument_id, open_time, arrival, 'volume_nonneg' FROM dirty WHERE volume < 0
 UNION ALL SELECT instrument_id, open_time, arrival, 'timestamp_alignment' FROM dirty WHERE epoch_us(open_time) % 3600000000 <> 0)"""


@query("b8_structural_checks", f"{_CHECKS_SQL} SELECT {_AT}, check_name, 'quarantined' AS severity FROM checks")
def b8_structural_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(quality.quarantined(dirty(candles(spark, sf))), "check_name", "severity")


@query(
    "b9_retained_split",
    f"""{_CHECKS_SQL} SELECT {_AT}, (SELECT count(*) FROM checks c WHERE c.arrival = d.arrival) > 0 AS rejected, {r6('close')} AS close FROM dirty d""",
)
def b9_retained_split(spark: SparkSession, sf: str) -> DataFrame:
    bars = dirty(candles(spark, sf))
    good = quality.retained(bars).withColumn("rejected", F.lit(False))
    bad = quality.rejected(bars).withColumn("rejected", F.lit(True)).drop("violations")
    return _shown(good.unionByName(bad), "rejected", "close")


@query(
    "b1_step_seconds",
    f"""{WITH_CANDLES} SELECT instrument_id, 3600 AS step_s, count(*) AS bars FROM candles GROUP BY 1
    UNION ALL SELECT instrument_id, 900, count(*) FROM (SELECT DISTINCT event_type AS instrument_id, epoch_us(ts) // 900000000 FROM events) GROUP BY 1""",
)
def b1_step_seconds(spark: SparkSession, sf: str) -> DataFrame:
    bars = candles(spark, sf).unionByName(candles(spark, sf, "15m"))
    return bars.groupBy("instrument_id", intervals.step_seconds("interval").alias("step_s")).agg(F.count(F.lit(1)).alias("bars"))


_NOW = "2024-01-20 12:30:00"


@query(
    "b2_close_time",
    f"""{WITH_CANDLES} SELECT {_AT}, epoch_us(open_time + INTERVAL 1 HOUR) AS close_time, open_time + INTERVAL 1 HOUR <= TIMESTAMP '{_NOW}' AS is_closed FROM candles""",
)
def b2_close_time(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    bars = candles(spark, sf).withColumns({"close_time": intervals.close_time(), "is_closed": intervals.is_closed(now)})
    return _shown(bars, "close_time", "is_closed")


# -- sequence quality ---------------------------------------------------------------------------

def _seq_ctes(rows: str) -> str:
    """Sequence events of a table of bars in the order of its ``arrival``."""
    return f"""seq AS (SELECT instrument_id, open_time, arrival, close, volume, lag(open_time) OVER w AS before,
   row_number() OVER w AS rn, count(*) OVER (PARTITION BY instrument_id) AS n FROM {rows} WINDOW w AS (PARTITION BY instrument_id ORDER BY arrival)),
 order_events AS (SELECT instrument_id, open_time, CASE WHEN open_time <= before THEN 'timestamp_monotonic' ELSE 'missing_interval' END AS check_name, epoch_us(before) AS before
   FROM seq WHERE open_time <= before OR open_time - before > INTERVAL 1 HOUR),
 runs AS (SELECT *, coalesce(max(CASE WHEN volume <> 0 THEN rn END) OVER (PARTITION BY instrument_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS traded FROM seq),
 streaks AS (SELECT instrument_id, open_time, rn - traded - 1 AS streak FROM runs WHERE volume <> 0 AND rn - traded - 1 >= 5
   UNION ALL SELECT instrument_id, open_time, rn - traded FROM runs WHERE rn = n AND volume = 0 AND rn - traded >= 5),
 rets AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE (c - b) / b END AS ret FROM (SELECT instrument_id, open_time, rn, CAST(close AS DOUBLE) AS c, lag(CAST(close AS DOUBLE)) OVER (PARTITION BY instrument_id ORDER BY rn) AS b FROM seq)),
 sig AS (SELECT *, stddev_pop(ret) OVER w AS s, count(ret) OVER w AS k FROM rets WINDOW w AS (PARTITION BY instrument_id ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 moves AS (SELECT instrument_id, open_time, ret, s FROM sig WHERE k = 20 AND s > 0 AND abs(ret) > 10 * s)"""


_SEQ_SQL = f"{WITH_DIRTY}, {_seq_ctes('dirty')}"


@query(
    "e8_boundary_gaps",
    f"""{WITH_CANDLES} SELECT * FROM (SELECT instrument_id, epoch_us(lag(open_time) OVER ({_W})) AS gap_start, epoch_us(open_time) AS gap_end FROM candles)
    WHERE gap_end - gap_start > 3600000000""",
)
def e8_boundary_gaps(spark: SparkSession, sf: str) -> DataFrame:
    # Bars before the 10th play the part of what was stored before this batch.
    bars, cut = candles(spark, sf), F.lit("2024-01-10").cast("timestamp")
    before = bars.where(F.col("open_time") < cut)
    return quality.boundary_gaps(bars.where(F.col("open_time") >= cut), before).select("instrument_id", "gap_start", "gap_end")


@query(
    "e9_non_monotonic",
    f"""{WITH_DIRTY}, late AS (SELECT *, lag(open_time) OVER (PARTITION BY instrument_id ORDER BY arrival * 2 + CASE WHEN arrival % 7 = 0 THEN 801 ELSE 0 END) AS b FROM dirty)
    SELECT {_AT}, {us('b')} AS before FROM late WHERE open_time <= b""",
)
def e9_non_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    # Every seventh bar or so comes after bars that follow it.
    late = F.col("arrival") * 2 + F.when(F.col("arrival") % 7 == 0, 801).otherwise(0)
    found = quality.order_violations(dirty(candles(spark, sf)).withColumn("arrival", late)).where(F.col("check_name") == "timestamp_monotonic")
    return _shown(found.withColumn("before", F.col("details")["previous_open_time"].cast("timestamp")), "before")


@query("e10_zero_volume_streaks", f"{_SEQ_SQL} SELECT {_AT}, streak FROM streaks")
def e10_zero_volume_streaks(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.zero_volume_streaks(dirty(candles(spark, sf)))
    return _shown(found.withColumn("streak", F.col("details")["streak_length"].cast("long")), "streak")


@query("e11_price_moves", f"{_SEQ_SQL} SELECT {_AT}, {r6('ret')} AS ret, {r6('s')} AS sigma FROM moves")
def e11_price_moves(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.price_moves(dirty(candles(spark, sf)))
    d = F.col("details")
    return _shown(found.withColumns({"ret": d["return"].cast("double"), "sigma": d["stddev"].cast("double")}), "ret", "sigma")


def all_events_sql(before: str, rows: str) -> str:
    """All events of a table of bars (with details of streaks), as ``checks`` after the tables in ``before``."""
    return f"""{before}, {_seq_ctes(rows)}, checks AS (
 SELECT instrument_id, open_time, 'ohlc_invariant' AS check_name, 'quarantined' AS severity, '' AS streak FROM {rows} WHERE high < greatest(open, close) OR low > least(open, close) OR high < low
 UNION ALL SELECT instrument_id, open_time, 'volume_nonneg', 'quarantined', '' FROM {rows} WHERE volume < 0
 UNION ALL SELECT instrument_id, open_time, 'timestamp_alignment', 'quarantined', '' FROM {rows} WHERE epoch_us(open_time) % 3600000000 <> 0
 UNION ALL SELECT instrument_id, open_time, check_name, 'flagged', '' FROM order_events
 UNION ALL SELECT instrument_id, open_time, 'zero_volume_streak', 'flagged', CAST(streak AS VARCHAR) FROM streaks
 UNION ALL SELECT instrument_id, open_time, 'price_move_sigma', 'flagged', '' FROM moves)"""


_ALL_EVENTS = all_events_sql(WITH_DIRTY, "dirty")


@query("g1_all_violations", f"{_ALL_EVENTS} SELECT {_AT}, check_name, severity FROM checks")
def g1_all_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(quality.violations(dirty(candles(spark, sf))), "check_name", "severity")


@query("d3_violation_counts", f"{_ALL_EVENTS} SELECT check_name, severity, count(*) AS n FROM checks GROUP BY 1, 2")
def d3_violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.count_by_check(quality.violations(dirty(candles(spark, sf))))


# -- gaps ---------------------------------------------------------------------------------------

_FROM, _TO = "2024-01-01 00:00:00", "2024-01-30 23:45:00"
MAINTENANCE_SQL = """SELECT ts AS window_start, ts + INTERVAL 30 MINUTE AS window_end FROM events WHERE event_id % 200 = 0"""


def maintenance(spark: SparkSession, sf: str) -> DataFrame:
    """Half an hour of maintenance from every 200th event on."""
    e = table(spark, sf, "events").where(F.col("event_id") % 200 == 0)
    return e.select(F.col("ts").alias("window_start"), intervals.plus_seconds("ts", 1800).alias("window_end"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps with their classification. The gaps, few beside the bars, become a table first."""
    found = staged(gaps.gaps(candles(spark, sf, "15m"), *_window()), scratch(spark, "gaps"))
    return gaps.classify(found, maintenance(spark, sf))


def _window() -> tuple:
    return F.lit(_FROM).cast("timestamp"), F.lit(_TO).cast("timestamp")


_MISSING_SQL = f"""{WITH_M15}, slots AS (SELECT i.instrument_id, t.open_time FROM (SELECT DISTINCT instrument_id FROM candles) i,
   (SELECT unnest(generate_series(TIMESTAMP '{_FROM}', TIMESTAMP '{_TO}', INTERVAL 15 MINUTE)) AS open_time) t),
 missing AS (SELECT s.* FROM slots s ANTI JOIN candles c ON c.instrument_id = s.instrument_id AND c.open_time = s.open_time)"""
_GAPS_SQL = f"""{_MISSING_SQL}, islands AS (SELECT *, epoch_us(open_time) // 900000000 - row_number() OVER (PARTITION BY instrument_id ORDER BY open_time) AS g FROM missing),
 gaps AS (SELECT instrument_id, min(open_time) AS gap_start, max(open_time) AS gap_end, count(*) AS missing_count,
   list(epoch_us(open_time) ORDER BY open_time) AS slots FROM islands GROUP BY instrument_id, g),
 maintenance AS ({MAINTENANCE_SQL}),
 classified AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM maintenance m WHERE g.gap_start <= m.window_end AND g.gap_end >= m.window_start) THEN 'maintenance' ELSE 'unexplained' END AS classification FROM gaps g)"""


@query("c2_missing_slots", f"{_MISSING_SQL} SELECT {_AT} FROM missing")
def c2_missing_slots(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.missing_slots(candles(spark, sf, "15m"), *_window()).select("instrument_id", "open_time")


@query("g2_expected_except_actual", f"{_MISSING_SQL} SELECT instrument_id, count(*) AS missing FROM missing GROUP BY 1")
def g2_expected_except_actual(spark: SparkSession, sf: str) -> DataFrame:
    missing = gaps.missing_slots(candles(spark, sf, "15m"), *_window())
    return missing.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("missing"))


@query(
    "e12_missing_runs",
    f"""{_GAPS_SQL} SELECT instrument_id, {us('gap_start')} AS gap_start, {us('gap_end')} AS gap_end, missing_count, classification,
    list_sum(slots)::BIGINT AS slot_sum FROM classified""",
)
def e12_missing_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = gaps.missing_open_times(classified(spark, sf))
    total = F.aggregate("missing_open_times", F.lit(0).cast("long"), lambda a, t: a + F.unix_micros(t))
    return found.select("instrument_id", "gap_start", "gap_end", "missing_count", "classification", total.alias("slot_sum"))


@query("c3_maintenance_overlap", f"{_GAPS_SQL} SELECT instrument_id, {us('gap_start')} AS gap_start FROM classified WHERE classification = 'maintenance'")
def c3_maintenance_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).where(F.col("classification") == "maintenance").select("instrument_id", "gap_start")


@query("d4_gap_summary", f"{_GAPS_SQL} SELECT classification, count(*) AS gaps, CAST(sum(missing_count) AS BIGINT) AS missing_count FROM classified GROUP BY 1")
def d4_gap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.summary(classified(spark, sf))


GAPS_SQL = _GAPS_SQL
GAP_WINDOW = _window
ALL_EVENTS_SQL = _ALL_EVENTS

# -- as-of joins and event order ----------------------------------------------------------------


_ORDERS_CTE = f"""{WITH_CANDLES}, asks AS (SELECT event_id AS order_id, event_type AS instrument_id, date_trunc('hour', ts) AS signal_time FROM events),
 nxt AS (SELECT *, lag(open_time) OVER ({_W}) AS signal_time FROM candles)"""


@query(
    "c5_next_bar",
    f"""{_ORDERS_CTE} SELECT order_id, epoch_us(n.open_time) AS open_time, {r6('n.open')} AS open FROM asks a
    JOIN nxt n ON n.instrument_id = a.instrument_id AND n.signal_time = a.signal_time""",
)
def c5_next_bar(spark: SparkSession, sf: str) -> DataFrame:
    asks = table(spark, sf, "events").select(
        F.col("event_id").alias("order_id"), F.col("event_type").alias("instrument_id"), F.lit("1h").alias("interval"),
        F.date_trunc("hour", "ts").alias("signal_time"),
    )
    return asof.join_next_bar(asks, candles(spark, sf)).select("order_id", F.col("bar.open_time").alias("open_time"), F.col("bar.open").alias("open"))


@query(
    "c6_last_n_bars",
    f"""{WITH_CANDLES}, asks AS (SELECT event_id AS request_id, event_type AS instrument_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts FROM events),
    seen AS (SELECT a.request_id, c.open_time, c.close, row_number() OVER (PARTITION BY a.request_id ORDER BY c.open_time DESC) AS bar_rank
      FROM asks a JOIN candles c ON c.instrument_id = a.instrument_id AND c.open_time + INTERVAL 1 HOUR < a.ts)
    SELECT request_id, bar_rank, epoch_us(open_time) AS open_time, {r6('close')} AS close FROM seen WHERE bar_rank <= 3""",
)
def c6_last_n_bars(spark: SparkSession, sf: str) -> DataFrame:
    at = F.when(F.col("event_id") % 3 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts"))
    asks = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("instrument_id"), F.lit("1h").alias("interval"), at.alias("ts")
    )
    return asof.last_n_bars(asks, candles(spark, sf), 3).select("request_id", "bar_rank", "open_time", "close")


@query(
    "f2_last_n_per_key",
    f"""{WITH_CANDLES} SELECT * FROM (SELECT {_AT}, {r6('close')} AS close, row_number() OVER (PARTITION BY instrument_id ORDER BY open_time DESC) AS bar_rank FROM candles) WHERE bar_rank <= 5""",
)
def f2_last_n_per_key(spark: SparkSession, sf: str) -> DataFrame:
    # The view of each series at an instant after all its bars have closed.
    bars = candles(spark, sf)
    asks = bars.groupBy("instrument_id", "interval").agg(F.max("open_time").alias("last")).select(
        "instrument_id", "interval", F.col("instrument_id").alias("request_id"), intervals.plus_seconds("last", 7200).alias("ts")
    )
    return asof.last_n_bars(asks, bars, 5).select("instrument_id", "open_time", "close", "bar_rank")


@query(
    "f1_event_order",
    f"""{WITH_CANDLES}, both_sizes AS (SELECT instrument_id, open_time, 3600 AS step_s FROM candles
      UNION ALL SELECT DISTINCT event_type, make_timestamp((epoch_us(ts) // 900000000) * 900000000), 900 FROM events)
    SELECT instrument_id, epoch_us(open_time) AS open_time, CAST(step_s AS BIGINT) AS step_s,
      row_number() OVER (ORDER BY epoch_us(open_time) + step_s * 1000000::BIGINT, step_s, instrument_id) AS event_no FROM both_sizes""",
)
def f1_event_order(spark: SparkSession, sf: str) -> DataFrame:
    bars = candles(spark, sf).unionByName(candles(spark, sf, "15m"))
    return asof.event_order(bars).select("instrument_id", "open_time", "step_s", "event_no")
