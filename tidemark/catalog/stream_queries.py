"""Streams fed from the given tables slice by slice, one run each on one checkpoint, then read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.catalog.base import CATALOG, WITH_CANDLES, WITH_DIRTY, candles, dirty, query, r6, table, us
from tidemark.catalog.store_queries import _GOOD, frame_texts
from tidemark.catalog.series_queries import all_events_sql, ema_cte
from tidemark.plans.jobs import staged
from tidemark.session import scratch
from tidemark.sources import landing
from tidemark.streaming import bars as bar_streams
from tidemark.streaming import gapgate, indicators, watch

_AT = f"instrument_id, {us('open_time')} AS open_time"
_SLICES = 3
Run = Callable[[DataFrame, str], StreamingQuery]


def delivered(rows: DataFrame, time: str, label: str, run: Run) -> str:
    """Deliver ``rows`` to a stream in consecutive slices of ``time``; returns the path ``run`` has written to.

    The borders divide the stretch the data cover; the first slice is open to the past, the last to the future, and rows
    without a time come last. Each slice is written by all tasks and then read in a run of its own, on the same
    checkpoint: the order between slices is kept without a single task that writes them.
    """
    spark = rows.sparkSession
    path = scratch(spark, label)
    rows = staged(rows, f"{path}/all")
    low, high = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    span = (high - low) // _SLICES + 1 if low is not None else 1
    number = F.least(F.coalesce(F.floor((F.unix_micros(time) - F.lit(low or 0)) / F.lit(span)), F.lit(_SLICES - 1)), F.lit(_SLICES - 1))
    for n in range(_SLICES):
        rows.where(number == n).write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out").awaitTermination()
    return f"{path}/out"


def collected(rows: DataFrame, time: str, label: str, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of ``rows``, appended to a table."""
    schema = []

    def run(source: DataFrame, path: str) -> StreamingQuery:
        made = stream(source)
        schema.append(made.schema)
        return bar_streams.to_table(made, path, f"{path}-checkpoint")

    path = delivered(rows, time, label, run)
    return rows.sparkSession.read.schema(schema[-1]).parquet(path)


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with the exchange time they come at; such without one come last."""
    at = F.timestamp_millis(F.get_json_object("value", "$.E").try_cast("long"))
    return frame_texts(spark, sf).withColumn("at", at)


@query(
    "j1_closed_bar_stream",
    f"""{WITH_CANDLES} SELECT upper(instrument_id) AS symbol, {us('open_time')} AS open_time, {r6('close')} AS close, epoch_us(open_time) + 3600000000 AS exchange_ts, true AS received FROM candles WHERE arrival % 2 = 0""",
)
def j1_closed_bar_stream(spark: SparkSession, sf: str) -> DataFrame:
    done = bar_streams.stored_once(collected(_frames(spark, sf), "at", "closed", lambda s: bar_streams.closed_bars(s.select("value"))))
    return done.select("symbol", "open_time", "close", "exchange_ts", F.col("local_recv_ts").isNotNull().alias("received"))


@query(
    "j2_latest_open_bar",
    f"""{WITH_CANDLES} SELECT upper(instrument_id) AS symbol, max({us('open_time')}) AS open_time, max_by({r6('close')}, open_time) AS close FROM candles WHERE arrival % 2 = 1 GROUP BY 1""",
)
def j2_latest_open_bar(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda s, out: bar_streams.each_update(bar_streams.latest_open_bars(s.select("value")), out, f"{out}-checkpoint")
    path = delivered(_frames(spark, sf), "at", "latest", run)
    newest = F.max_by(F.struct("open_time", "close"), "batch_id")
    return spark.read.parquet(path).groupBy("symbol").agg(newest.alias("b")).select("symbol", "b.*")


_PANEL_SQL = f"""WITH {", ".join(f"{n} AS ({CATALOG[q].sql})" for n, q in (("e1", "e1_sma"), ("e2", "e2_ema"), ("e3", "e3_rsi"), ("e4", "e4_atr"), ("e5", "e5_bollinger"), ("e6", "e6_macd"), ("e7", "e7_rolling_volatility")))}
 SELECT * FROM e1 {" ".join(f"JOIN {n} USING (instrument_id, open_time)" for n in ("e2", "e3", "e4", "e5", "e6", "e7"))}"""


@query("j3_stream_indicators", _PANEL_SQL)
def j3_stream_indicators(spark: SparkSession, sf: str) -> DataFrame:
    rows = candles(spark, sf).select("instrument_id", "interval", "open_time", "high", "low", "close")
    done = collected(rows, "open_time", "indicators", indicators.stream_indicators).drop("interval")
    return done.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in indicators.OUTPUTS})


@query("j3_stream_macd", CATALOG["e6_macd"].sql)
def j3_stream_macd(spark: SparkSession, sf: str) -> DataFrame:
    return j3_stream_indicators(spark, sf).select("instrument_id", "open_time", "macd", "macd_signal", "macd_hist")


@query("j3_stream_volatility", CATALOG["e7_rolling_volatility"].sql)
def j3_stream_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return j3_stream_indicators(spark, sf).select("instrument_id", "open_time", "volatility")


_IDLE, _CHECK = 7200, 1800


@query(
    "j4_staleness",
    f"""WITH m AS (SELECT event_type AS symbol, ts AS at_ts FROM events UNION ALL SELECT DISTINCT event_type, TIMESTAMP '2024-02-01' FROM events),
    p AS (SELECT symbol, at_ts, lag(at_ts) OVER (PARTITION BY symbol ORDER BY at_ts) AS since FROM m),
    c AS (SELECT symbol, since, unnest(generate_series({_IDLE // _CHECK + 1}, CAST(floor((epoch_us(at_ts) - epoch_us(since)) / {_CHECK * 1_000_000}) AS BIGINT))) AS n FROM p WHERE since IS NOT NULL)
    SELECT symbol, CAST(n * {_CHECK} AS DOUBLE) AS idle_seconds, epoch_us(since) + n * {_CHECK * 1_000_000} AS detected_at FROM c""",
)
def j4_staleness(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"))
    end = seen.select("symbol").distinct().withColumn("at", F.lit("2024-02-01").cast("timestamp"))
    return collected(seen.unionByName(end), "at", "stale", lambda s: watch.event_staleness(s, _IDLE, _CHECK))


@query(
    "j5_sequence_jumps",
    """WITH m AS (SELECT event_type AS stream, event_id AS arrival, event_id // 3 AS seq FROM events)
    SELECT stream, previous_sequence, seq AS received_sequence FROM (SELECT *, lag(seq) OVER (PARTITION BY stream ORDER BY arrival) AS previous_sequence FROM m)
    WHERE seq <> previous_sequence + 1""",
)
def j5_sequence_jumps(spark: SparkSession, sf: str) -> DataFrame:
    messages = table(spark, sf, "events").select(
        F.col("event_type").alias("stream"), F.col("event_id").alias("arrival"), F.expr("event_id div 3").alias("seq"), "ts"
    )
    return collected(messages, "ts", "jumps", watch.sequence_jumps)


@query(
    "j6_gap_gate",
    f"""{WITH_CANDLES}, filled AS (SELECT instrument_id, open_time, close, volume, row_number() OVER w AS rn, min(open_time) OVER (PARTITION BY instrument_id) AS first FROM candles WINDOW w AS (PARTITION BY instrument_id ORDER BY open_time))
    SELECT {_AT}, {r6('close')} AS close FROM filled WHERE epoch_us(open_time) - epoch_us(first) = (rn - 1) * 3600000000""",
)
def j6_gap_gate(spark: SparkSession, sf: str) -> DataFrame:
    # Live bars come on time; every fifth one is lost and only comes with the backfill ten days later.
    # The first bar of a series is never late, and real gaps in the data stay closed for ever.
    rows = candles(spark, sf)
    begins = rows.groupBy("instrument_id").agg(F.min("open_time").alias("first"))
    late = (F.col("arrival") % 5 == 0) & (F.col("open_time") > F.col("first"))
    ten_days = F.expr("interval 10 days")
    sent = rows.join(begins, "instrument_id").withColumn("sent", F.when(late, F.col("open_time") + ten_days).otherwise(F.col("open_time")))
    live = sent.select("instrument_id", "interval", "open_time", *gapgate.FIGURES, "sent")
    return collected(live, "sent", "gated", gapgate.released).select("instrument_id", "open_time", "close")


@query("j7_stream_ingest", f"{WITH_DIRTY} SELECT {_AT}, {r6('close')} AS close FROM dirty WHERE {_GOOD}")
def j7_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda s, out: bar_streams.ingest(s, out, f"{out}/checkpoint").trigger(availableNow=True).start()
    path = delivered(dirty(candles(spark, sf)), "open_time", "ingest", run)
    return bar_streams.ingested(spark.read.parquet(f"{path}/candles")).select("instrument_id", "open_time", "close")


_MID = "2024-01-12"


@query("j3_stream_from_store", f"SELECT * FROM ({_PANEL_SQL}) WHERE open_time >= epoch_us(TIMESTAMP '{_MID}')")
def j3_stream_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that begins in the middle of the bars goes on from the stored ones as if it had seen them."""
    rows = candles(spark, sf).select("instrument_id", "interval", "open_time", "high", "low", "close")
    cut = F.lit(_MID).cast("timestamp")
    stored = rows.where(F.col("open_time") < cut)
    done = collected(rows.where(F.col("open_time") >= cut), "open_time", "from-store", lambda s: indicators.stream_indicators(s, stored=stored)).drop("interval")
    return done.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in indicators.OUTPUTS})


@query(
    "j6_gate_from_store",
    f"""{WITH_CANDLES}, kept AS (SELECT instrument_id, max(open_time) AS last FROM candles WHERE open_time < TIMESTAMP '{_MID}' GROUP BY 1),
    rest AS (SELECT c.*, last, row_number() OVER (PARTITION BY c.instrument_id ORDER BY open_time) AS rn FROM candles c JOIN kept k ON k.instrument_id = c.instrument_id AND open_time > last)
    SELECT {_AT}, {r6('close')} AS close FROM rest WHERE epoch_us(open_time) - epoch_us(last) = rn * 3600000000""",
)
def j6_gate_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """The first slot a gate waits for is the one after the last stored bar; bars of the day before it come again."""
    rows, cut = candles(spark, sf), F.lit(_MID).cast("timestamp")
    stored = rows.where(F.col("open_time") < cut)
    live = rows.where(F.col("open_time") >= cut - F.expr("interval 1 day")).select("instrument_id", "interval", "open_time", *gapgate.FIGURES)
    sent = live.withColumn("sent", F.when(F.hour("open_time") % 5 == 0, F.col("open_time") + F.expr("interval 10 days")).otherwise(F.col("open_time")))
    return collected(sent, "sent", "gate-from-store", lambda s: gapgate.released(s, stored=stored)).select("instrument_id", "open_time", "close")


_LATE_SQL = f"""{WITH_DIRTY}, late AS (SELECT * REPLACE (arrival * 2 + CASE WHEN arrival % 7 = 0 THEN 801 ELSE 0 END AS arrival) FROM dirty)"""


@query("j7_stream_events", f"{all_events_sql(_LATE_SQL, 'late')} SELECT {_AT}, check_name, severity, streak FROM checks")
def j7_stream_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of three micro-batches equal those of all bars at once. Every seventh bar or so comes after bars that follow it."""
    late = F.col("arrival") * 2 + F.when(F.col("arrival") % 7 == 0, 801).otherwise(0)
    rows = dirty(candles(spark, sf)).withColumn("arrival", late).withColumn("sent", F.timestamp_seconds("arrival"))
    run = lambda s, out: bar_streams.ingest(s, out, f"{out}/checkpoint").trigger(availableNow=True).start()
    events = bar_streams.ingested_events(spark.read.parquet(f"{delivered(rows, 'sent', 'events', run)}/events"))
    streak = F.coalesce(F.get_json_object("details", "$.streak_length"), F.lit("")).alias("streak")
    return events.select("instrument_id", "open_time", "check_name", "severity", streak)


_HOURS = "generate_series((SELECT min(open_time) FROM candles), (SELECT max(open_time) FROM candles), INTERVAL 1 HOUR)"


@query(
    "j8_live_chain",
    f"""{WITH_CANDLES}, dense AS (SELECT i.instrument_id, t.open_time, coalesce(c.close, 50) AS close FROM (SELECT DISTINCT instrument_id FROM candles) i, (SELECT unnest({_HOURS}) AS open_time) t
      LEFT JOIN candles c ON c.instrument_id = i.instrument_id AND c.open_time = t.open_time),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY open_time) AS rn FROM dense), {ema_cte('smooth', 'numbered', 'close', 12)}
    SELECT n.instrument_id, {us('n.open_time')} AS open_time, {r6('y')} AS ema, CASE WHEN count(*) OVER w = 20 THEN {r6('avg(CAST(close AS DOUBLE)) OVER w')} END AS sma
    FROM numbered n JOIN smooth s ON s.instrument_id = n.instrument_id AND s.rn = n.rn WINDOW w AS (PARTITION BY n.instrument_id ORDER BY n.open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def j8_live_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Frames to closed bars, through the gate, to indicators, as one stream: no hour is missing, but every fifth comes ten days late."""
    rows = candles(spark, sf)
    hour = F.expr("interval 1 hour")
    first, last = rows.agg(F.min("open_time"), F.max("open_time")).first()
    grid = rows.select("instrument_id").distinct().select("instrument_id", F.explode(F.sequence(F.lit(first), F.lit(last), hour)).alias("open_time"))
    known = rows.select("instrument_id", "open_time", *gapgate.FIGURES)
    dense = grid.join(known, ["instrument_id", "open_time"], "left").na.fill(50, list(gapgate.FIGURES))
    late = (F.hour("open_time") % 5 == 0) & (F.col("open_time") > F.lit(first))
    sent = F.when(late, F.col("open_time") + F.expr("interval 10 days")).otherwise(F.col("open_time"))
    bars = dense.withColumns({"symbol": F.upper("instrument_id"), "interval": F.lit("1h"), "is_closed": F.lit(True), "exchange_ts": F.col("open_time") + hour})
    frames = landing.frames_of(bars.withColumn("exchange_ts", sent + hour))
    timed = frames.withColumn("at", F.timestamp_millis(F.get_json_object("value", "$.E").cast("long")))

    def chain(source: DataFrame) -> DataFrame:
        closed = bar_streams.closed_bars(source.select("value"), received=False).withColumn("instrument_id", F.lower("symbol"))
        return indicators.stream_indicators(gapgate.released(closed))

    done = collected(timed, "at", "chain", chain)
    return done.select("instrument_id", "open_time", F.nanvl("ema", F.lit(None).cast("double")).alias("ema"), F.nanvl("sma", F.lit(None).cast("double")).alias("sma"))
