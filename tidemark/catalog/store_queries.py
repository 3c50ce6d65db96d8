"""Sources, stores, reference data, versions, registry, audits and composite ingest jobs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.account_queries import run_bars
from tidemark.catalog.base import (
    CATALOG,
    WITH_CANDLES,
    WITH_DIRTY,
    candles,
    dirty,
    query,
    r6,
    table,
    us,
)
from tidemark.catalog.series_queries import ALL_EVENTS_SQL, GAP_WINDOW, GAPS_SQL, all_events_sql, maintenance
from tidemark.functions.hashing import row_hash
from tidemark.functions.intervals import expected_slots, month_slices, plus_seconds, step_seconds
from tidemark.functions.venue import is_tradeable, map_status
from tidemark.operators import audit, quality, reference, registry, versioning
from tidemark.plans import jobs
from tidemark.schemas import MONEY, money
from tidemark.session import scratch
from tidemark.sources import archive, buckets, landing, store
from tidemark.sources.candles import DatasetVersion, load_version, registered_version

_AT = f"instrument_id, {us('open_time')} AS open_time"
_NOW = datetime(2024, 1, 25)


# -- A1-A4: reading -----------------------------------------------------------------------------


@query(
    "a1_load_dataset_version",
    f"""{WITH_CANDLES} SELECT upper(instrument_id) AS symbol, {_AT}, {r6('close')} AS close FROM candles
    WHERE instrument_id IN ('click', 'view') AND open_time >= TIMESTAMP '2024-01-05' AND open_time < TIMESTAMP '2024-01-13'""",
)
def a1_load_dataset_version(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "candles")
    bars = candles(spark, sf)
    bars.write.partitionBy("interval").parquet(path)
    known = bars.select(F.col("instrument_id").alias("id"), F.upper("instrument_id").alias("symbol")).distinct()
    version = DatasetVersion(("click", "view"), date(2024, 1, 5), date(2024, 1, 12))
    stored = spark.read.schema(bars.schema).parquet(path)
    return load_version(stored, known, version, ["1h"]).select("symbol", "instrument_id", "open_time", "close")


def _no_versions(versions: DataFrame) -> DataFrame:
    """A registry nothing is registered in."""
    columns = ("symbol_set", "date_range_start", "date_range_end")
    return versions.select(F.col("content_hash").alias("dataset_version_id"), "content_hash", *columns, F.lit(_NOW).alias("created_at")).limit(0)


@query(
    "c1_candle_instrument_join",
    f"""{WITH_CANDLES} SELECT upper(instrument_id) AS symbol, count(*) AS bars, {r6('sum(close)')} AS close_sum FROM candles GROUP BY 1""",
)
def c1_candle_instrument_join(spark: SparkSession, sf: str) -> DataFrame:
    bars = candles(spark, sf)
    known = bars.select(F.col("instrument_id").alias("id"), F.upper("instrument_id").alias("symbol")).distinct()
    # The whole table is registered as one version, and loaded by its row in the registry.
    versions = versioning.dataset_versions(bars)
    registry_rows = jobs.staged(versioning.register(_no_versions(versions), versions, _NOW), scratch(spark, "versions"))
    version = registered_version(registry_rows, registry_rows.first()["dataset_version_id"])
    joined = load_version(bars, known, version, ["1h"])
    return joined.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum("close").alias("close_sum"))


@query(
    "a2_kline_files",
    f"""{WITH_CANDLES} SELECT {_AT}, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low, {r6('close')} AS close, {r6('volume')} AS volume, trade_count FROM candles""",
)
def a2_kline_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "klines")
    text = lambda c: F.col(c).cast("string")
    ms = F.unix_millis("open_time").cast("string")
    kline = F.array(
        ms, text("open"), text("high"), text("low"), text("close"), text("volume"), ms, F.lit("0"), text("trade_count"), F.lit("0"), F.lit("0"), F.lit("0")
    )
    bars = candles(spark, sf).withColumn("day", F.to_date("open_time"))
    pages = bars.groupBy("instrument_id", "day").agg(F.to_json(F.collect_list(kline)).alias("value"))
    pages.select("instrument_id", "value").write.partitionBy("instrument_id").text(path)
    return landing.klines(spark.read.text(path)).select("instrument_id", "open_time", "open", "high", "low", "close", "volume", "trade_count")


def frame_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as a venue would send them; bars whose first event id is odd are still open."""
    return candles(spark, sf).withColumns(
        {"symbol": F.upper("instrument_id"), "is_closed": F.col("arrival") % 2 == 0, "exchange_ts": plus_seconds("open_time", 3600)}
    )


def frame_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Kline frames mixed with other messages and damaged text."""
    good = landing.frames_of(frame_bars(spark, sf))
    noise = table(spark, sf, "events").where(F.col("event_id") % 7 == 0).select("props")
    broken = noise.select(F.concat(F.lit('{"e":"kline","E":1,'), "props").alias("value"))
    other = noise.select(F.concat(F.lit('{"e":"trade","k":'), "props", F.lit("}")).alias("value"))
    return good.unionByName(broken).unionByName(other)


@query(
    "a3_kline_frames",
    f"""{WITH_CANDLES} SELECT upper(instrument_id) AS symbol, {us('open_time')} AS open_time, {r6('close')} AS close, arrival % 2 = 0 AS is_closed, epoch_us(open_time) + 3600000000 AS exchange_ts FROM candles""",
)
def a3_kline_frames(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "frames")
    frame_texts(spark, sf).write.text(path)
    return landing.parse_frames(spark.read.text(path)).select("symbol", "open_time", "close", "is_closed", "exchange_ts")


# Symbols made of parts: the brand is the quote side, sizes make the rules, some rules are absent.
_SYMBOLS_SQL = """SELECT 'P' || p_partkey AS symbol, p_brand AS quote, CASE WHEN p_partkey % 7 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status,
 CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE p_size / 100.0 END AS tick, CASE WHEN p_partkey % 59 = 0 THEN NULL ELSE 0.001 END AS lot, 10.0 + p_partkey % 3 AS notional FROM part"""


def exchange_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Exchange-info documents of about a hundred symbols each."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")

    def filter_(kind: str, tick=none, step=none, notional=none):
        return F.struct(F.lit(kind).alias("filterType"), tick.alias("tickSize"), step.alias("stepSize"), notional.alias("minNotional"))

    filters = F.array(
        filter_("PRICE_FILTER", tick=F.lit("9")),
        filter_("PRICE_FILTER", tick=F.when(key % 53 != 0, text(F.col("p_size") / 100.0))),
        filter_("LOT_SIZE", step=F.when(key % 59 != 0, F.lit("0.001"))),
        filter_("PERCENT_PRICE_BY_SIDE"),
        F.when(key % 2 == 0, filter_("NOTIONAL", notional=text(10.0 + key % 3))).otherwise(filter_("MIN_NOTIONAL", notional=text(10.0 + key % 3))),
    )
    kept = F.when(key % 53 == 0, F.filter(filters, lambda f: f["filterType"] != "PRICE_FILTER")).otherwise(filters)
    symbol = F.struct(
        F.concat(F.lit("P"), text(key)).alias("symbol"), F.when(key % 7 == 0, "BREAK").otherwise("TRADING").alias("status"),
        F.concat(F.lit("P"), text(key)).alias("baseAsset"), F.col("p_brand").alias("quoteAsset"), F.lit(8).alias("baseAssetPrecision"),
        F.lit(8).alias("quoteAssetPrecision"), kept.alias("filters"),
    )
    documents = p.groupBy(F.floor(key / 100).alias("page")).agg(F.collect_list(symbol).alias("symbols"))
    return documents.select(F.lit("UTC").alias("timezone"), F.lit(0).cast("long").alias("serverTime"), "symbols")


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "exchange-info")
    exchange_documents(spark, sf).write.json(path)
    return landing.exchange_info(spark, path)


@query("a4_exchange_info", f"WITH s AS ({_SYMBOLS_SQL}) SELECT symbol, quote, status, CAST(5 - CASE WHEN tick IS NULL THEN 2 ELSE 0 END AS BIGINT) AS filters FROM s")
def a4_exchange_info(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).select("symbol", F.col("quoteAsset").alias("quote"), "status", F.size("filters").alias("filters"))


@query(
    "b5_trading_rules",
    f"WITH s AS ({_SYMBOLS_SQL}) SELECT symbol, {r6('tick')} AS tick_size, {r6('lot')} AS lot_size, {r6('notional')} AS min_notional FROM s",
)
def b5_trading_rules(spark: SparkSession, sf: str) -> DataFrame:
    return reference.trading_rules(_symbols(spark, sf)).select("symbol", "tick_size", "lot_size", "min_notional")


@query(
    "b6_normalised_instruments",
    f"""WITH s AS ({_SYMBOLS_SQL}) SELECT symbol, status, tick IS NOT NULL AND lot IS NOT NULL AS kept,
    CASE WHEN tick IS NULL AND lot IS NULL THEN 'no value in filters for: PRICE_FILTER.tickSize, LOT_SIZE.stepSize'
     WHEN tick IS NULL THEN 'no value in filters for: PRICE_FILTER.tickSize' WHEN lot IS NULL THEN 'no value in filters for: LOT_SIZE.stepSize' END AS reason
    FROM (SELECT symbol, tick, lot, CASE WHEN tick IS NULL OR lot IS NULL THEN NULL WHEN status = 'TRADING' THEN 'trading' ELSE 'halted' END AS status FROM s)""",
)
def b6_normalised_instruments(spark: SparkSession, sf: str) -> DataFrame:
    symbols = _symbols(spark, sf)
    good = reference.instruments(symbols, "v1").select("symbol", "status", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason"))
    bad = reference.skipped_symbols(symbols).select("symbol", F.lit(None).cast("string").alias("status"), F.lit(False).alias("kept"), "reason")
    return good.unionByName(bad)


# -- archive ------------------------------------------------------------------------------------


def _hot(spark: SparkSession, sf: str) -> DataFrame:
    return candles(spark, sf).withColumns(
        {"venue": F.lit("venue-1"), "symbol": F.upper("instrument_id"), "is_closed": F.lit(True), "source": F.lit("events")}
    ).drop("arrival")


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("instrument_id"), "ts", F.col("event_id").cast("string").alias("venue_trade_id"), money("value").alias("price"),
        F.regexp_extract("props", "[0-9]+", 0).cast(MONEY).alias("qty"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.lit("venue-1").alias("venue"), F.upper("event_type").alias("symbol"),
    )


def _archived(spark: SparkSession, rows: DataFrame, dataset: str) -> tuple[str, DataFrame, DataFrame]:
    path = scratch(spark, "archive")
    report, trimmed = archive.archive(rows, dataset, path, "b1", _NOW, retention_days=10)
    return path, report, trimmed


@query(
    "a5_archive_candles",
    f"""{WITH_CANDLES} SELECT upper(instrument_id) AS symbol, 2024 AS year, 1 AS month, {us('open_time')} AS open_time, {r6('close')} AS close FROM candles WHERE open_time < TIMESTAMP '2024-01-15'""",
)
def a5_archive_candles(spark: SparkSession, sf: str) -> DataFrame:
    path, report, _ = _archived(spark, _hot(spark, sf), "candle")
    return archive.read(spark, "candle", path, report).select("symbol", "year", "month", "open_time", "close")


@query("a7_archive_rerun", CATALOG["a5_archive_candles"].sql)
def a7_archive_rerun(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch twice over the same hot table, then once over what trimming left: everything is read back once."""
    path, _, trimmed = _archived(spark, _hot(spark, sf), "candle")
    trimmed = jobs.staged(trimmed, scratch(spark, "hot"))
    archive.archive(_hot(spark, sf), "candle", path, "b1", _NOW, retention_days=10)
    archive.archive(trimmed, "candle", path, "b1", _NOW, retention_days=10)
    return archive.read(spark, "candle", path).select("symbol", "year", "month", "open_time", "close")


@query(
    "a6_archive_ticks",
    f"""SELECT upper(event_type) AS symbol, CAST(event_id AS VARCHAR) AS venue_trade_id, {us('ts')} AS ts, {r6('value')} AS price FROM events WHERE ts < TIMESTAMP '2024-01-15'""",
)
def a6_archive_ticks(spark: SparkSession, sf: str) -> DataFrame:
    path, report, _ = _archived(spark, _ticks(spark, sf), "trade_tick")
    return archive.read(spark, "trade_tick", path, report).select("symbol", "venue_trade_id", "ts", "price")


@query("a7_verify_then_trim", f"{WITH_CANDLES} SELECT {_AT}, {r6('close')} AS close FROM candles WHERE open_time >= TIMESTAMP '2024-01-15'")
def a7_verify_then_trim(spark: SparkSession, sf: str) -> DataFrame:
    return _archived(spark, _hot(spark, sf), "candle")[2].select("instrument_id", "open_time", "close")


@query(
    "a8_exact_decimal_layout",
    f"{WITH_CANDLES} SELECT {_AT}, CAST(close AS VARCHAR) AS close, CAST(volume AS VARCHAR) AS volume FROM candles WHERE open_time < TIMESTAMP '2024-01-15'",
)
def a8_exact_decimal_layout(spark: SparkSession, sf: str) -> DataFrame:
    path, _, _ = _archived(spark, _hot(spark, sf), "candle")
    return archive.read_layout(spark, "candle", path).select("instrument_id", "open_time", "close", "volume")


# -- upsert, insert, logs -----------------------------------------------------------------------


@query(
    "a9_candle_upsert",
    f"""{WITH_CANDLES} SELECT {_AT}, {r6('CASE WHEN arrival % 3 = 0 THEN close + 2 ELSE close END')} AS close FROM candles""",
)
def a9_candle_upsert(spark: SparkSession, sf: str) -> DataFrame:
    # Every third bar arrives again, twice: the later arrival wins.
    bars = candles(spark, sf)
    again = bars.where(F.col("arrival") % 3 == 0).withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    revised = again.withColumn("close", (F.col("close") + F.col("turn")).cast(MONEY)).withColumn("arrival", F.col("turn").cast("long")).drop("turn")
    return store.upsert(bars.drop("arrival"), revised).select("instrument_id", "open_time", "close")


@query("a9_bucketed_upsert", CATALOG["a9_candle_upsert"].sql)
def a9_bucketed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same bars written over a bucketed table: what is stored is not shuffled."""
    bars = candles(spark, sf)
    again = bars.where(F.col("arrival") % 3 == 0).withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    revised = again.withColumn("close", (F.col("close") + F.col("turn")).cast(MONEY)).withColumn("arrival", F.col("turn").cast("long")).drop("turn")
    count = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    after = buckets.upsert(buckets.create(bars.drop("arrival"), buckets=count), revised, buckets=count)
    return spark.table(after).select("instrument_id", "open_time", "close")


_SNAPS = """(SELECT s_suppkey, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS snapshot_date, d, CASE WHEN s_suppkey % 7 = d THEN s_acctbal <= 0 ELSE s_acctbal > 0 END AS tradeable
 FROM supplier, (VALUES (0), (1), (2)) t(d))"""


def suppliers_on(spark: SparkSession, sf: str, day: int) -> DataFrame:
    """Suppliers as instruments, their status on the n-th day."""
    solvent, flip = F.col("s_acctbal") > 0, F.col("s_suppkey") % 7 == day
    open_ = F.when(flip, ~solvent).otherwise(solvent)
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("instrument_id"), F.lit("v1").alias("venue_id"), F.when(open_, "TRADING").otherwise("BREAK").alias("venue_status")
    ).withColumn("status", map_status("venue_status"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    days = [reference.universe_snapshot(suppliers_on(spark, sf, d), date(2024, 1, 1 + d), _NOW) for d in range(3)]
    return days[0].unionByName(days[1]).unionByName(days[2])


@query("b4_status", "SELECT s_suppkey AS instrument_id, CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal <= 0 ELSE s_acctbal > 0 END AS tradeable, CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal <= 0 ELSE s_acctbal > 0 END AS trading FROM supplier")
def b4_status(spark: SparkSession, sf: str) -> DataFrame:
    return suppliers_on(spark, sf, 0).select("instrument_id", is_tradeable().alias("tradeable"), (F.col("status") == "trading").alias("trading"))


@query("a10_insert_if_absent", f"SELECT s_suppkey AS instrument_id, snapshot_date, tradeable FROM {_SNAPS} WHERE s_suppkey % 2 = 1")
def a10_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    # Even ids were captured already; every row comes twice.
    day = snapshots(spark, sf)
    there = day.where(F.col("instrument_id") % 2 == 0)
    fresh = store.insert_if_absent(there, day.unionByName(day), ["snapshot_date", "venue_id", "instrument_id"])
    return fresh.select("instrument_id", "snapshot_date", F.col("is_tradeable").alias("tradeable"))


@query("b7_tradeable_on", f"SELECT s_suppkey AS instrument_id FROM {_SNAPS} WHERE d = 2 AND tradeable")
def b7_tradeable_on(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "universe")
    store.append(snapshots(spark, sf), path, "snapshot_date")
    return reference.tradeable_on(spark.read.parquet(path), date(2024, 1, 3))


@query("d5_snapshot_capture", f"SELECT snapshot_date, CAST(count_if(s_suppkey % 3 <> 0) AS BIGINT) AS captured, CAST(count_if(s_suppkey % 3 = 0) AS BIGINT) AS already_captured FROM {_SNAPS} GROUP BY 1")
def d5_snapshot_capture(spark: SparkSession, sf: str) -> DataFrame:
    snaps = snapshots(spark, sf)
    return reference.snapshot_summary(snaps, snaps.where(F.col("instrument_id") % 3 == 0))


@query(
    "a11_event_log",
    f"""{ALL_EVENTS_SQL} SELECT {_AT}, check_name, severity, true AS has_details, epoch_us(TIMESTAMP '2024-01-25') AS detected_at FROM checks""",
)
def a11_event_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "events")
    store.append(quality.event_log(quality.violations(dirty(candles(spark, sf))), _NOW), path)
    has = F.get_json_object("details", "$").isNotNull()
    return spark.read.parquet(path).select("instrument_id", "open_time", "check_name", "severity", has.alias("has_details"), "detected_at")


_RANGES_SQL = """SELECT i.instrument_id, r.range_start, r.range_end FROM (SELECT DISTINCT event_type AS instrument_id FROM events) i,
 (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10 23:00:00'), (TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-20 23:00:00'), (TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-05')) r(range_start, range_end)"""


@query(
    "a12_resume_plan",
    f"""{WITH_CANDLES}, ranges AS ({_RANGES_SQL}), done AS (SELECT r.instrument_id, r.range_start, max(c.open_time) AS last FROM ranges r JOIN candles c
      ON c.instrument_id = r.instrument_id AND c.open_time BETWEEN r.range_start AND r.range_end AND c.open_time < TIMESTAMP '2024-01-18' GROUP BY 1, 2)
    SELECT r.instrument_id, epoch_us(r.range_start) AS range_start, epoch_us(coalesce(last + INTERVAL 1 HOUR, r.range_start)) AS resume_from, coalesce(last + INTERVAL 1 HOUR, r.range_start) > range_end AS completed
    FROM ranges r LEFT JOIN done d ON d.instrument_id = r.instrument_id AND d.range_start = r.range_start""",
)
def a12_resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    ts = lambda text: F.lit(text).cast("timestamp")
    spans = [("2024-01-01", "2024-01-10 23:00:00"), ("2024-01-11", "2024-01-20 23:00:00"), ("2024-02-01", "2024-02-05")]
    structs = F.array(*[F.struct(ts(a).alias("range_start"), ts(b).alias("range_end")) for a, b in spans])
    bars = candles(spark, sf)
    ranges = bars.select("instrument_id", "interval").distinct().select("instrument_id", "interval", F.inline(structs))
    # Landed bars carry the range they were fetched for; everything from the 18th on is missing.
    first = F.when(F.col("open_time") < ts("2024-01-11"), 0).otherwise(1)
    landed = bars.where((F.col("open_time") < ts("2024-01-18"))).withColumn("_r", F.element_at(structs, first + 1)).select(
        "instrument_id", "interval", "open_time", "_r.*"
    )
    plan = jobs.resume_plan(ranges, jobs.backfill_progress(landed))
    return plan.select("instrument_id", "range_start", "resume_from", "completed")


# -- reference merge ----------------------------------------------------------------------------

_V1 = "SELECT p_partkey, 'P' || p_partkey AS symbol, p_size / 100.0 AS tick, 0.001 AS lot FROM part WHERE p_partkey % 101 <> 1"
_V2 = """SELECT p_partkey, 'P' || p_partkey AS symbol, p_size / 100.0 + CASE WHEN p_partkey % 50 = 0 THEN 0.01 ELSE 0 END AS tick,
 CASE WHEN p_partkey % 75 = 0 THEN 0.002 ELSE 0.001 END AS lot FROM part WHERE p_partkey % 101 <> 2"""
_MERGE = f"WITH o AS ({_V1}), n AS ({_V2})"


def _version(spark: SparkSession, sf: str, second: bool) -> DataFrame:
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    tick, lot = F.col("p_size") / 100.0, F.lit(0.001)
    if second:
        tick = tick + F.when(key % 50 == 0, 0.01).otherwise(0.0)
        lot = F.when(key % 75 == 0, 0.002).otherwise(0.001)
    rows = p.where(key % 101 != (2 if second else 1)).select(
        F.lit("v1").alias("venue_id"), F.concat(F.lit("P"), key.cast("string")).alias("symbol"), F.lit("spot").alias("asset_class"),
        F.col("p_brand").alias("base_currency"), F.lit("USDT").alias("quote_currency"), tick.cast(MONEY).alias("tick_size"), lot.cast(MONEY).alias("lot_size"),
        F.lit(10).cast(MONEY).alias("min_notional"), F.lit("trading").alias("status"), key.cast("string").alias("instrument_id"),
        F.lit(datetime(2023, 1, 1)).alias("listed_at"), F.lit(datetime(2023, 1, 1)).alias("updated_at"),
    )
    return rows.drop("instrument_id", "listed_at", "updated_at") if second else rows


@query(
    "c4_reference_merge",
    f"""{_MERGE} SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(CAST(o.p_partkey AS VARCHAR), md5('v1|' || n.symbol)) AS instrument_id, {r6('coalesce(n.tick, o.tick)')} AS tick_size,
    {r6('coalesce(n.lot, o.lot)')} AS lot_size, epoch_us(CASE WHEN o.symbol IS NULL THEN TIMESTAMP '2024-01-25' ELSE TIMESTAMP '2023-01-01' END) AS listed_at,
    epoch_us(CASE WHEN n.symbol IS NULL THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-25' END) AS updated_at FROM o FULL JOIN n ON n.symbol = o.symbol""",
)
def c4_reference_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = reference.merge(_version(spark, sf, False), _version(spark, sf, True), _NOW)
    return merged.select("symbol", "instrument_id", "tick_size", "lot_size", "listed_at", "updated_at")


@query(
    "c4_reference_drift",
    f"""{_MERGE} SELECT n.symbol, 'tick_size' AS field, {r6('o.tick')} AS old, {r6('n.tick')} AS new FROM o JOIN n ON n.symbol = o.symbol WHERE n.p_partkey % 50 = 0
    UNION ALL SELECT n.symbol, 'lot_size', {r6('o.lot')}, {r6('n.lot')} FROM o JOIN n ON n.symbol = o.symbol WHERE n.p_partkey % 75 = 0""",
)
def c4_reference_drift(spark: SparkSession, sf: str) -> DataFrame:
    return reference.drift(_version(spark, sf, False), _version(spark, sf, True)).drop("venue_id")


@query(
    "d6_import_summary",
    f"""{_MERGE} SELECT CAST(count_if(o.symbol IS NULL) AS BIGINT) AS inserted, CAST(count_if(o.symbol IS NOT NULL) AS BIGINT) AS updated,
    CAST(sum(CASE WHEN o.symbol IS NULL THEN 0 ELSE CAST(n.p_partkey % 50 = 0 AS INT) + CAST(n.p_partkey % 75 = 0 AS INT) END) AS BIGINT) AS changed_fields,
    (SELECT count(*) FROM part WHERE p_partkey % 53 = 0 OR p_partkey % 59 = 0) AS skipped FROM n LEFT JOIN o ON n.symbol = o.symbol""",
)
def d6_import_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reference.import_summary(_version(spark, sf, False), _version(spark, sf, True), reference.skipped_symbols(_symbols(spark, sf)))


# -- hashes and versions ------------------------------------------------------------------------

_HASHED = """hashed AS (SELECT *, sha256('{"close":"' || close || '","instrument_id":"' || instrument_id || '","open_time":"' || strftime(open_time, '%Y-%m-%d %H:%M:%S') || '","volume":"' || volume || '"}') AS row_hash FROM candles)"""
_HASH_COLUMNS = ("instrument_id", "open_time", "close", "volume")


@query("h1_row_fingerprint", f"{WITH_CANDLES}, {_HASHED} SELECT {_AT}, row_hash FROM hashed")
def h1_row_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return candles(spark, sf).select("instrument_id", "open_time", row_hash(_HASH_COLUMNS).alias("row_hash"))


_WORD_SUMS = " || ',' || ".join(f"CAST(sum(CAST(('0x' || substr(row_hash, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(
    "h2_content_hash",
    f"""{WITH_CANDLES}, {_HASHED} SELECT instrument_id, count(*) AS row_count,
    sha256(instrument_id || '|' || CAST(CAST(min(open_time) AS DATE) AS VARCHAR) || '|' || CAST(CAST(max(open_time) AS DATE) AS VARCHAR) || '|' || CAST(count(*) AS VARCHAR) || '|' || {_WORD_SUMS}) AS content_hash
    FROM hashed GROUP BY 1""",
)
def h2_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    bars = candles(spark, sf).withColumn("_k", F.col("instrument_id"))
    return versioning.dataset_versions(bars, ["_k"], _HASH_COLUMNS).select(F.col("_k").alias("instrument_id"), "row_count", "content_hash")


@query(
    "h3_register_version",
    f"{WITH_CANDLES} SELECT instrument_id, count(*) AS registrations FROM (SELECT DISTINCT instrument_id FROM candles) GROUP BY 1",
)
def h3_register_version(spark: SparkSession, sf: str) -> DataFrame:
    # The same data registered twice, in another row order, is one version.
    bars = candles(spark, sf).withColumn("_k", F.col("instrument_id"))
    first = versioning.dataset_versions(bars, ["_k"])
    again = versioning.dataset_versions(bars.orderBy(F.col("close").desc()), ["_k"])
    known = versioning.register(_no_versions(first), first, _NOW)
    everything = known.unionByName(versioning.register(known, again, _NOW))
    return everything.groupBy(F.element_at("symbol_set", 1).alias("instrument_id")).agg(F.count(F.lit(1)).alias("registrations"))


_EDITED_SQL = """edited AS (SELECT * REPLACE (CASE WHEN arrival % 101 = 0 THEN close + 1 ELSE close END AS close) FROM candles WHERE arrival % 151 <> 0 AND NOT (instrument_id = 'click' AND CAST(open_time AS DATE) = DATE '2024-01-05')),
 old_days AS (SELECT instrument_id, CAST(open_time AS DATE) AS day, count(*) AS n FROM candles GROUP BY 1, 2), new_days AS (SELECT instrument_id, CAST(open_time AS DATE) AS day, count(*) AS n FROM edited GROUP BY 1, 2),
 touched AS (SELECT DISTINCT instrument_id, CAST(open_time AS DATE) AS day FROM candles WHERE arrival % 101 = 0 OR arrival % 151 = 0 OR (instrument_id = 'click' AND CAST(open_time AS DATE) = DATE '2024-01-05'))"""


def edited(spark: SparkSession, sf: str) -> DataFrame:
    """The bars with some closes changed, some bars gone, and one day of one series gone whole."""
    bars, i = candles(spark, sf), F.col("arrival")
    lost = (F.col("instrument_id") == "click") & (F.to_date("open_time") == F.lit("2024-01-05").cast("date"))
    return bars.where((i % 151 != 0) & ~lost).withColumn("close", F.when(i % 101 == 0, F.col("close") + 1).otherwise(F.col("close")).cast(MONEY))


@query(
    "h2_version_diff",
    f"""{WITH_CANDLES}, {_EDITED_SQL} SELECT instrument_id, CAST(day AS VARCHAR) AS day, CASE WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change, a.n AS rows_before, coalesce(b.n, 0) AS rows_after
    FROM touched JOIN old_days a USING (instrument_id, day) LEFT JOIN new_days b USING (instrument_id, day)""",
)
def h2_version_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The days in which two stored versions differ, from their trees alone."""
    paths = []
    for rows in (candles(spark, sf), edited(spark, sf)):
        paths.append(scratch(spark, "tree"))
        versioning.store_tree(versioning.version_tree(rows, _HASH_COLUMNS), paths[-1])
    before, after = (spark.read.parquet(p) for p in paths)
    return versioning.version_diff(before, after).drop("interval")


@query(
    "h2_merkle_tree",
    f"""{WITH_CANDLES}, {_HASHED}, days AS (SELECT instrument_id, CAST(open_time AS DATE) AS day, sha256(string_agg(row_hash, '' ORDER BY open_time)) AS hash, count(*) AS n FROM hashed GROUP BY 1, 2),
    series AS (SELECT instrument_id, sha256(string_agg(sha256(CAST(day AS VARCHAR) || '|' || hash), '' ORDER BY day)) AS hash, sum(n) AS n FROM days GROUP BY 1)
    SELECT 'day' AS level, instrument_id, CAST(day AS VARCHAR) AS day, hash, n AS row_count FROM days UNION ALL SELECT 'series', instrument_id, NULL, hash, CAST(n AS BIGINT) FROM series
    UNION ALL SELECT 'whole', NULL, NULL, sha256(string_agg(sha256(instrument_id || '|1h|' || hash), '' ORDER BY instrument_id)), CAST(sum(n) AS BIGINT) FROM series""",
)
def h2_merkle_tree(spark: SparkSession, sf: str) -> DataFrame:
    return versioning.version_tree(candles(spark, sf), _HASH_COLUMNS).drop("interval")


@query(
    "h2_changed_rows",
    f"""{WITH_CANDLES}, {_EDITED_SQL} SELECT 'removed' AS change, {_AT}, {r6('close')} AS close FROM candles WHERE arrival % 101 = 0 OR arrival % 151 = 0 OR (instrument_id = 'click' AND CAST(open_time AS DATE) = DATE '2024-01-05')
    UNION ALL SELECT 'added', {_AT}, {r6('close')} FROM edited WHERE arrival % 101 = 0""",
)
def h2_changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The bars behind a difference, read from the differing days only."""
    before, after = candles(spark, sf), edited(spark, sf)
    days = versioning.version_diff(versioning.version_tree(before), versioning.version_tree(after))
    return versioning.changed_rows(before, after, days).select("change", "instrument_id", "open_time", "close")


@query(
    "h4_month_slices",
    """WITH c AS (SELECT o_custkey AS id, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1),
    m AS (SELECT *, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH)) AS m FROM c WHERE s < e)
    SELECT id, epoch_us(greatest(m, s)) AS slice_start, epoch_us(least(m + INTERVAL 1 MONTH, e)) AS slice_end FROM m WHERE greatest(m, s) < least(m + INTERVAL 1 MONTH, e)""",
)
def h4_month_slices(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return spans.select("id", F.inline(month_slices("s", "e")))


@query(
    "h5_expected_slots",
    """WITH u AS (SELECT user_id, min(ts) AS s, min(ts) + INTERVAL 1 HOUR * (user_id % 5 - 1) AS e FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN e >= s THEN CAST((epoch_us(e) - epoch_us(s)) // 900000000 + 1 AS BIGINT) ELSE 0 END AS slots, CASE WHEN e >= s THEN epoch_us(s) + ((epoch_us(e) - epoch_us(s)) // 900000000) * 900000000 END AS last_slot FROM u""",
)
def h5_expected_slots(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("s"))
    spans = spans.withColumn("e", plus_seconds("s", (F.col("user_id") % 5 - 1) * 3600)).withColumn("x", expected_slots("s", "e", step_seconds(F.lit("15m"))))
    return spans.select("user_id", F.size("x").alias("slots"), F.try_element_at("x", F.lit(-1)).alias("last_slot"))


# -- registry -----------------------------------------------------------------------------------


@query(
    "d7_trial_count",
    "SELECT o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS trial_count FROM orders",
)
def d7_trial_count(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("strategy_id"), F.col("o_orderdate").alias("started_at"))
    return registry.trial_counts(runs).select("run_id", "trial_count")


@query(
    "a13_run_registry",
    f"""{WITH_CANDLES}, runs AS (SELECT instrument_id || '-' || v AS run_id, row_number() OVER (PARTITION BY v ORDER BY instrument_id) - 1 AS trials FROM (SELECT DISTINCT instrument_id FROM candles), (VALUES (8), (12)) t(v))
    SELECT run_id AS backtest_run_id, trials AS trial_count_at_time_of_run, true AS volatility_is_null, true AS has_return FROM runs""",
)
def a13_run_registry(spark: SparkSession, sf: str) -> DataFrame:
    bars = run_bars(spark, sf)
    sheet = jobs.backtest(bars, jobs.toggle_rule("every"), 5)["tearsheet"]
    nothing = F.lit(None).cast("string")
    runs = bars.select("run_id", "every").distinct().select(
        "run_id", F.col("every").cast("string").alias("strategy_id"), nothing.alias("code_hash"), nothing.alias("params"), nothing.alias("dataset_version_id"),
        F.lit(7).cast("long").alias("seed"), nothing.alias("git_sha"), F.lit(_NOW).alias("started_at"), F.lit(_NOW).alias("finished_at"), F.lit("tests").alias("operator"),
    )
    # A third of the runs is logged first, the rest finds it there.
    path = scratch(spark, "registry")
    early = runs.where(F.col("run_id") < "d")
    registry.log_runs(early, runs.limit(0), sheet, path)
    registry.log_runs(runs, spark.read.parquet(f"{path}/backtest_run"), sheet, path)
    logged = registry.logged_metrics(spark, path)
    return logged.select(
        "backtest_run_id", "trial_count_at_time_of_run", F.col("volatility").isNull().alias("volatility_is_null"), F.col("total_return").isNotNull().alias("has_return")
    )


# -- latency ------------------------------------------------------------------------------------


@query(
    "b10_venue_latency",
    """SELECT event_type AS symbol, count(*) AS bars, CAST(sum(user_id % 100) AS BIGINT) AS total_ms, CAST(max(user_id % 100) AS BIGINT) AS max_ms FROM events GROUP BY 1""",
)
def b10_venue_latency(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    received = F.timestamp_micros(F.unix_micros("ts") + (F.col("user_id") % 100) * 1000)
    rows = e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("exchange_ts"), received.alias("local_recv_ts"))
    found = landing.venue_latency(rows)
    return found.select("symbol", "bars", F.round(F.col("mean_ms") * F.col("bars")).cast("long").alias("total_ms"), "max_ms")


@query(
    "b10_latency_sketches",
    """WITH l AS (SELECT event_type AS symbol, CAST(user_id % 100 AS BIGINT) AS ms FROM events), n AS (SELECT symbol, ms, row_number() OVER (PARTITION BY symbol ORDER BY ms) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM l)
    SELECT symbol, count(*) AS bars, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms, true AS p50_ok, true AS p99_ok FROM n GROUP BY 1""",
)
def b10_latency_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles from sketches of single days, stored and merged; each is checked to have its rank among the exact latencies, within 1 in 100."""
    e = table(spark, sf, "events")
    received = F.timestamp_micros(F.unix_micros("ts") + (F.col("user_id") % 100) * 1000)
    rows = e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("exchange_ts"), received.alias("local_recv_ts"))
    found = landing.merged_latency(jobs.staged(landing.latency_sketches(rows), scratch(spark, "sketches")))
    exact = rows.select("symbol", (F.unix_millis("local_recv_ts") - F.unix_millis("exchange_ts")).alias("ms")).join(found, "symbol")
    below = lambda c: F.count_if(F.col("ms") < F.col(c)) / F.count(F.lit(1))
    upto = lambda c: F.count_if(F.col("ms") <= F.col(c)) / F.count(F.lit(1))
    fits = lambda c, r: ((below(c) <= r + 0.01) & (upto(c) >= r - 0.01)).alias(c.replace("_ms", "_ok"))
    total = F.round(F.first("mean_ms") * F.first("bars")).cast("long").alias("total_ms")
    return exact.groupBy("symbol").agg(F.first("bars").alias("bars"), total, F.first("max_ms").alias("max_ms"), fits("p50_ms", 0.5), fits("p99_ms", 0.99))


# -- audits -------------------------------------------------------------------------------------


@query(
    "l1_check_rules",
    f"""{WITH_DIRTY} SELECT {_AT}, 'ck_candle_high_vs_open_close' AS rule FROM dirty WHERE high < greatest(open, close)
    UNION ALL SELECT {_AT}, 'ck_candle_low_vs_open_close' FROM dirty WHERE low > least(open, close)
    UNION ALL SELECT {_AT}, 'ck_candle_high_vs_low' FROM dirty WHERE high < low UNION ALL SELECT {_AT}, 'ck_candle_volume_nonneg' FROM dirty WHERE volume < 0""",
)
def l1_check_rules(spark: SparkSession, sf: str) -> DataFrame:
    return audit.check_violations(dirty(candles(spark, sf)), audit.CHECKS["candle"]).select("instrument_id", "open_time", "rule")


@query(
    "l1_tick_rules",
    """SELECT 'ck_trade_tick_price_positive' AS rule, count(*) AS n FROM events WHERE value <= 0 HAVING count(*) > 0
    UNION ALL SELECT 'ck_trade_tick_qty_positive', count(*) FROM events WHERE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) <= 0""",
)
def l1_tick_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.check_violations(_ticks(spark, sf), audit.CHECKS["trade_tick"])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("l2_unique_keys", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def l2_unique_keys(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("l3_orphans", "SELECT l_orderkey, l_partkey FROM lineitem ANTI JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) p ON p_partkey = l_partkey")
def l3_orphans(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "part").where(F.col("p_partkey") % 10 != 0)
    return audit.orphans(table(spark, sf, "lineitem"), "l_partkey", known, "p_partkey").select("l_orderkey", "l_partkey")


# Rows for every table with rules, as expressions that both engines read.
_RULE_TABLES: dict[str, tuple[str, list[str]]] = {
    "venue": ("nation", ["n_nationkey AS id", "CASE WHEN n_nationkey = 3 THEN 'KENYA' ELSE n_name END AS name"]),
    "account": ("customer", ["c_custkey AS id", "c_nationkey AS venue_id", "c_mktsegment AS name"]),
    "strategy": ("supplier", ["s_suppkey AS id", "s_nationkey % 5 AS name", "s_suppkey % 40 AS code_hash"]),
    "strategy_instance": ("supplier", ["s_acctbal AS allocated_capital", "s_acctbal + 500 AS capacity_usd"]),
    "instrument": ("part", ["p_partkey AS id", "CASE WHEN p_partkey % 17 = 0 THEN 99 ELSE p_size % 25 END AS venue_id", "p_type AS symbol", "p_retailprice - 905 AS tick_size", "p_size - 1 AS lot_size", "p_size - 2 AS min_notional"]),
    "universe_snapshot": ("lineitem", ["l_shipdate AS snapshot_date", "l_linenumber AS venue_id", "CASE WHEN l_partkey % 50 = 0 THEN -1 ELSE l_partkey END AS instrument_id"]),
    "order": ("orders", ["o_orderkey AS id", "o_custkey % 25 AS venue_id", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS client_order_id", "o_totalprice AS qty", "o_totalprice - 1000 + o_orderkey % 3000 AS filled_qty"]),
    "order_event": ("lineitem", ["CASE WHEN l_orderkey % 31 = 0 THEN -l_orderkey ELSE l_orderkey END AS order_id", "l_linenumber % 4 AS seq"]),
    "fill": ("lineitem", ["l_orderkey * 10 + l_linenumber AS id", "l_suppkey % 3 AS venue_id", "l_orderkey AS venue_fill_id", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey + l_linenumber END AS order_id", "l_quantity - 1 AS qty", "l_discount AS price"]),
    "ledger_entry": ("lineitem", ["l_suppkey AS account_id", "l_orderkey * 10 + l_linenumber + l_partkey % 2 AS ref_fill_id", "l_tax AS amount"]),
    "signal": ("events", ["value / 95 AS strength"]),
    "order_intent": ("events", ["user_id % 7 AS target_qty", "CASE WHEN event_id % 3 = 0 THEN 'limit' ELSE 'market' END AS order_type", "CASE WHEN event_id % 2 = 0 THEN value END AS limit_price"]),
    "risk_decision": ("events", ["event_id % 900 AS order_intent_id", "value > 20 AS approved", "CASE WHEN event_id % 4 = 0 THEN 'limit' END AS rejection_reason"]),
    "system_halt_event": ("events", ["CASE WHEN event_id % 5 = 0 THEN ts END AS cleared_at", "CASE WHEN event_id % 10 = 0 THEN 'desk' END AS cleared_by"]),
    "backtest_trade": ("lineitem", ["l_linenumber AS entry_ts", "CASE WHEN l_linenumber > 1 THEN l_quantity END AS exit_ts", "l_orderkey AS backtest_run_id", "l_partkey AS instrument_id"]),
    "equity_snapshot": ("events", ["user_id AS id", "ts AS ts"]),
    "position": ("lineitem", ["l_suppkey AS account_id", "l_partkey AS instrument_id", "l_linenumber AS strategy_instance_id"]),
}


def _audit_sql() -> str:
    """Every rule as a query of its own."""
    named = ", ".join(f'"t_{name}" AS (SELECT {", ".join(columns)} FROM {source})' for name, (source, columns) in _RULE_TABLES.items())
    parts = []
    for name in _RULE_TABLES:
        parts += [f"SELECT '{name}: {rule}' AS rule, count(*) AS offences FROM \"t_{name}\" WHERE NOT ({text})" for rule, text in audit.CHECKS.get(name, {}).items()]
        for key in audit.UNIQUE_KEYS.get(name, ()):
            whole, columns = " AND ".join(f"{c} IS NOT NULL" for c in key), ", ".join(key)
            parts.append(f"SELECT '{name}: unique({columns})', count(*) FROM (SELECT 1 FROM \"t_{name}\" WHERE {whole} GROUP BY {columns} HAVING count(*) > 1)")
        for column, target, target_column in audit.REFERENCES.get(name, ()):
            if target in _RULE_TABLES:
                parts.append(f"SELECT '{name}: {column} -> {target}.{target_column}', count(*) FROM \"t_{name}\" WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {target_column} FROM \"t_{target}\")")
    return f"WITH {named} SELECT * FROM ({' UNION ALL '.join(parts)}) AS t(rule, offences) WHERE offences > 0"


@query("l_audit_all", _audit_sql())
def l_audit_all(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of seventeen tables: checks, keys and references in one pass over each."""
    return audit.audit_all({name: table(spark, sf, source).selectExpr(*columns) for name, (source, columns) in _RULE_TABLES.items()})


# -- composite jobs -----------------------------------------------------------------------------

_GOOD = "high >= greatest(open, close) AND low <= least(open, close) AND high >= low AND volume >= 0 AND epoch_us(open_time) % 3600000000 = 0"


@query(
    "k1_validate_and_ingest",
    f"""{WITH_DIRTY}, stored AS (SELECT *, false AS fresh FROM candles WHERE open_time < TIMESTAMP '2024-01-06'), batch AS (SELECT *, true AS fresh FROM dirty WHERE {_GOOD} AND open_time >= TIMESTAMP '2024-01-04')
    SELECT {_AT}, {r6('close')} AS close, coalesce(fresh, false) AS fresh, CASE WHEN fresh THEN open_time + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25' ELSE true END AS is_closed FROM batch
    UNION ALL SELECT {_AT}, {r6('close')}, false, true FROM stored s ANTI JOIN batch b ON b.instrument_id = s.instrument_id AND b.open_time = s.open_time""",
)
def k1_validate_and_ingest(spark: SparkSession, sf: str) -> DataFrame:
    stored = candles(spark, sf).where(F.col("open_time") < datetime(2024, 1, 6)).drop("arrival").withColumns({"is_closed": F.lit(True), "source": F.lit("old")})
    batch = dirty(candles(spark, sf)).where(F.col("open_time") >= datetime(2024, 1, 4)).drop("trade_count")
    after, _ = jobs.validate_and_ingest(batch, stored, "batch", _NOW)
    return after.select("instrument_id", "open_time", "close", (F.col("source") == "batch").alias("fresh"), "is_closed")


_K1_ROWS = f"""{WITH_DIRTY}, batch AS (SELECT * FROM dirty WHERE open_time >= TIMESTAMP '2024-01-04'), starts AS (SELECT instrument_id, min(open_time) AS start FROM batch GROUP BY 1),
 line AS (SELECT * FROM batch UNION ALL SELECT * REPLACE (epoch_us(open_time) // 1000000 - 10000000000 AS arrival) FROM candles SEMI JOIN starts ON candles.instrument_id = starts.instrument_id AND open_time < start AND open_time < TIMESTAMP '2024-01-06')"""


@query(
    "k1_events",
    f"""{all_events_sql(_K1_ROWS, 'line')} SELECT {_AT}, check_name, severity, streak, epoch_us(TIMESTAMP '2024-01-25') AS detected_at FROM checks JOIN starts USING (instrument_id) WHERE open_time >= start""",
)
def k1_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a batch that goes on from the stored bars in front of it."""
    stored = candles(spark, sf).where(F.col("open_time") < datetime(2024, 1, 6)).drop("arrival").withColumns({"is_closed": F.lit(True), "source": F.lit("old")})
    batch = dirty(candles(spark, sf)).where(F.col("open_time") >= datetime(2024, 1, 4)).drop("trade_count")
    _, events = jobs.validate_and_ingest(batch, stored, "batch", _NOW)
    streak = F.coalesce(F.get_json_object("details", "$.streak_length"), F.lit("")).alias("streak")
    return events.select("instrument_id", "open_time", "check_name", "severity", streak, "detected_at")


@query(
    "k2_revalidation",
    f"""{WITH_CANDLES}, seq AS (SELECT *, lag(open_time) OVER (PARTITION BY instrument_id ORDER BY open_time) AS before FROM candles WHERE open_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20')
    SELECT {_AT}, 'missing_interval' AS check_name FROM seq WHERE open_time - before > INTERVAL 1 HOUR""",
)
def k2_revalidation(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.revalidate(candles(spark, sf), datetime(2024, 1, 3), datetime(2024, 1, 20))
    return found.where(F.col("check_name") == "missing_interval").select("instrument_id", "open_time", "check_name")


@query("k3_gap_scan", f"{GAPS_SQL} SELECT instrument_id, {us('gap_start')} AS range_start, {us('gap_end')} AS range_end FROM classified WHERE classification = 'unexplained'")
def k3_gap_scan(spark: SparkSession, sf: str) -> DataFrame:
    _, _, ranges = jobs.gap_scan(candles(spark, sf, "15m"), *GAP_WINDOW(), maintenance(spark, sf))
    return ranges.drop("interval")
