import time
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import START, bars, column
from tidemark.functions import intervals
from tidemark.operators import indicators, reference, versioning
from tidemark.session import scratch
from tidemark.sources import archive, landing, store
from tidemark.streaming import bars as bar_streams
from tidemark.streaming import gapgate, watch
from tidemark.streaming import indicators as live


def at(i):
    return START + timedelta(minutes=i)


# -- columns --------------------------------------------------------------------------------------


def test_slots_and_slices(spark):
    one = spark.range(1)
    ts = lambda t: F.lit(t).cast("timestamp")
    slots = lambda a, b: one.select(intervals.expected_slots(ts(a), ts(b), F.lit(60).cast("long")).alias("x")).head().x
    assert slots(at(0), at(2)) == [at(0), at(1), at(2)] and slots(at(2), at(0)) == [] and len(slots(at(0), at(0))) == 1
    cut = one.select(intervals.month_slices(ts(datetime(2025, 12, 15)), ts(datetime(2026, 2, 1))).alias("x")).head().x
    assert [(r.slice_start, r.slice_end) for r in cut] == [
        (datetime(2025, 12, 15), datetime(2026, 1, 1)), (datetime(2026, 1, 1), datetime(2026, 2, 1))
    ]


# -- landing --------------------------------------------------------------------------------------


def test_frames_keep_only_whole_klines(spark):
    good = '{"e":"kline","E":1767225600500,"s":"BTC","k":{"t":1767225600000,"T":1,"s":"BTC","i":"1m","o":"1","c":"2","h":"3","l":"0.5","v":"7","L":9,"V":"8","x":true}}'
    texts = [good, "not json", "[]", '{"e":"trade"}', '{"e":"kline"}', good.replace('"1"', '"abc"'), good.replace('"E":1767225600500,', "")]
    rows = landing.parse_frames(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert len(rows) == 1 and rows[0].open == 1 and rows[0].close == 2 and rows[0].is_closed
    assert rows[0].exchange_ts - rows[0].open_time == timedelta(milliseconds=500)


def test_kline_arrays_and_leftovers(spark):
    whole = '[1767225600000,"1","3","0.5","2","7",1,"0",4,"0","0","0"]'
    df = spark.createDataFrame([(f"[{whole},[1,2]]",), ("oops",)], "value string")
    assert landing.klines(df).collect()[0].trade_count == 4 and landing.klines(df).count() == 1
    assert landing.bad_klines(df).count() == 2


# -- stores ---------------------------------------------------------------------------------------


def test_upsert_last_arrival_wins(spark):
    b = bars(spark, [1, 2, 3])
    new = b.where("arrival = 1").withColumn("close", F.lit(9).cast("decimal(18,8)"))
    newer = new.withColumns({"close": F.lit(8).cast("decimal(18,8)"), "arrival": F.lit(7).cast("long")})
    assert column(store.upsert(b.drop("arrival"), newer.unionByName(new)), "close") == [1, 8, 3]


def test_archive_verifies_before_trimming(spark):
    times = [datetime(2026, 1, 30) + timedelta(days=i) for i in range(6)]
    hot = bars(spark, range(6), interval="1d", times=times).drop("arrival").withColumns(
        {"trade_count": F.lit(1).cast("long"), "is_closed": F.lit(True), "source": F.lit("t"), "venue": F.lit("v"), "symbol": F.lit("S")}
    )
    path = scratch(spark, "archive")
    report, trimmed = archive.archive(hot, "candle", path, "one", datetime(2026, 2, 13), retention_days=10)
    assert sorted((r.month, r.row_count, r.checksum_ok) for r in report.collect()) == [(1, 2, True), (2, 2, True)]
    assert column(trimmed, "close") == [4, 5] and column(archive.read(spark, "candle", path, report), "close") == [0, 1, 2, 3]
    # A month whose rows were damaged on the way fails alone and stays hot.
    old = archive.is_old("candle", datetime(2026, 2, 13), 10)
    damaged = hot.withColumn("close", F.when(F.month("open_time") == 1, F.col("close") + 1).otherwise(F.col("close")).cast("decimal(18,8)"))
    archive.write(damaged.where(old), "candle", path, "two")
    verdict = archive.verify(hot.where(old), "candle", path, "two")
    assert {r.month: r.checksum_ok for r in verdict.collect()} == {1: False, 2: True}
    assert column(archive.trim(hot, "candle", verdict, old), "close") == [0, 1, 4, 5]


def test_content_hash_tells_content_not_layout(spark):
    b = bars(spark, range(50))
    digest = lambda df: versioning.dataset_versions(df).head().content_hash
    same = digest(b)
    assert digest(b.orderBy(F.rand(3)).repartition(7)) == same
    assert digest(b.unionByName(b.limit(1))) != same and digest(b.where("arrival > 0")) != same
    assert digest(b.withColumn("close", F.when(F.col("arrival") == 9, 1).otherwise(F.col("close")).cast("decimal(18,8)"))) != same


def test_reference_rules_last_filter_wins(spark):
    kind = "array<struct<filterType string, tickSize string, stepSize string, minNotional string>>".replace(" string", ":string")
    rows = [
        ("ok", [("PRICE_FILTER", "1", None, None), ("PRICE_FILTER", "0.01", None, None), ("PRICE_FILTER", None, None, None), ("LOT_SIZE", None, "0.1", None), ("NOTIONAL", None, None, "5")]),
        ("no lot", [("PRICE_FILTER", "1", None, None), ("MIN_NOTIONAL", None, None, "5")]),
    ]
    df = spark.createDataFrame(rows, f"symbol string, filters {kind}").withColumns({"status": F.lit("TRADING"), "baseAsset": F.lit("B"), "quoteAsset": F.lit("Q")})
    assert [(r.symbol, r.tick_size) for r in reference.instruments(df, "v").collect()] == [("ok", Decimal("0.01"))]
    assert reference.skipped_symbols(df).head().reason == "no value in filters for: LOT_SIZE.stepSize"


# -- streams --------------------------------------------------------------------------------------


def _feed(spark, *batches):
    path = scratch(spark, "feed")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def _collect(stream):
    path = scratch(stream.sparkSession, "out")
    bar_streams.to_table(stream, path, f"{path}-checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def test_stream_indicators_equal_batch(spark):
    prices = np.round(np.abs(np.cumsum(np.random.default_rng(2).normal(0, 2, 120)) + 200), 2)
    b = bars(spark, prices, highs=prices + 2, lows=prices - 1)
    got = _collect(live.stream_indicators(_feed(spark, *[b.where(f"arrival >= {lo} and arrival < {hi}") for lo, hi in ((0, 1), (1, 15), (15, 16), (16, 120))])))
    batch = indicators.panel(b)
    smooth = indicators.macd(b)
    number = lambda xs: np.array([np.nan if x is None else x for x in xs], dtype=float)
    for name in ("sma", "rsi", "atr", "bb_upper", "bb_lower", "volatility"):
        np.testing.assert_allclose(number(column(got, name)), number(column(batch, name)), rtol=1e-8, err_msg=name)
    for name in ("macd", "macd_signal", "macd_hist"):
        np.testing.assert_allclose(number(column(got, name)), number(column(smooth, name)), atol=1e-9, err_msg=name)


def test_gap_gate_holds_and_releases_in_order(spark):
    b = bars(spark, range(8))
    pick = lambda *arrivals: b.where(F.col("arrival").isin(*arrivals))
    got = _collect(gapgate.gated(_feed(spark, pick(0, 1), pick(3, 5), pick(2, 3), pick(7), pick(1, 4))))
    assert column(got.where("status = 'released'"), "close") == [0, 1, 2, 3, 4, 5]
    assert sorted((int(r.close), r.status) for r in got.where("status != 'released'").collect()) == [(1, "repeat"), (3, "repeat")]


def test_gap_gate_reports_what_it_cannot_release(spark):
    b = bars(spark, range(12))
    pick = lambda low, high: b.where(F.col("arrival").between(low, high))
    shifted = b.where("arrival = 7").withColumn("open_time", F.timestamp_micros(F.unix_micros("open_time") + 1))
    got = _collect(gapgate.gated(_feed(spark, pick(5, 9), pick(0, 4).unionByName(shifted), pick(10, 11)))).collect()
    by = {}
    for r in got:
        by.setdefault(r.status, []).append(int(r.close))
    assert {k: sorted(v) for k, v in by.items()} == {"released": [5, 6, 7, 8, 9, 10, 11], "early": [0, 1, 2, 3, 4], "off_grid": [7]}
    assert {(r.open, r.high, r.low, r.volume) for r in got if r.close == 6} == {(Decimal(6), Decimal(7), Decimal(5), Decimal(10))}


def test_closed_bars_come_out_however_late(spark):
    b = bars(spark, range(61)).withColumns({"symbol": F.lit("S"), "is_closed": F.lit(True), "exchange_ts": F.col("open_time")})
    frames = landing.frames_of(b).withColumn("n", F.get_json_object("value", "$.k.c").cast("double"))
    late = frames.where("n < 5")
    got = _collect(bar_streams.closed_bars(_feed(spark, frames.where("n >= 5"), late, late).select("value")))
    assert got.count() == 66 and sorted(column(bar_streams.stored_once(got), "close")) == list(range(61))


def test_sequence_state_spans_batches(spark):
    m = spark.createDataFrame([("s", i, q) for i, q in enumerate([5, 6, 9, 10, 12])], "stream string, arrival long, seq long")
    got = _collect(watch.sequence_jumps(_feed(spark, m.where("arrival < 2"), m.where("arrival >= 2")))).collect()
    assert sorted((r.previous_sequence, r.received_sequence) for r in got) == [(6, 9), (10, 12)]


def test_staleness_repeats_while_idle(spark):
    stream = _feed(spark, spark.createDataFrame([("A",), ("B",)], "symbol string"))
    checkpoint = scratch(spark, "stale")
    query = watch.stale_symbols(stream, threshold_seconds=0.5, check_seconds=0.2).writeStream.format("memory").queryName("stale").option(
        "checkpointLocation", checkpoint
    ).trigger(processingTime="300 milliseconds").start()
    deadline = time.time() + 60
    try:
        while time.time() < deadline and spark.sql("select * from stale where symbol = 'A'").count() < 3:
            time.sleep(0.5)
    finally:
        query.stop()
    idle = [r.idle_seconds for r in spark.sql("select * from stale where symbol = 'A' order by detected_at").collect()]
    assert len(idle) >= 3 and idle == sorted(idle) and idle[0] > 0.5


def test_staleness_on_event_time_equals_the_recording(spark):
    """Also across batches, where a timer has told of some checks before the next message comes."""
    m = spark.createDataFrame([("A", at(0)), ("B", at(2)), ("A", at(5)), ("B", at(5)), ("A", at(9)), ("B", at(9))], "symbol string, at timestamp")
    batches = [m.where(F.col("at") <= F.lit(at(t))).where(F.col("at") > F.lit(at(t - 3))) for t in (2, 5, 8, 11)]
    stream = _feed(spark, *[b for b in batches if not b.isEmpty()])
    got = _collect(watch.event_staleness(stream, 60, 20)).orderBy("symbol", "detected_at").collect()
    want = watch.recorded_staleness(m, at(9), 60, 20).orderBy("symbol", "detected_at").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(want) > 10


def test_recorded_staleness(spark):
    m = spark.createDataFrame([("A", at(0)), ("A", at(1)), ("A", at(1) + timedelta(seconds=63))], "symbol string, at timestamp")
    got = watch.recorded_staleness(m, at(2) + timedelta(seconds=3)).orderBy("detected_at").collect()
    assert [r.idle_seconds for r in got] == [61.0, 62.0, 63.0]


def test_bad_stream_periods_raise(spark):
    with pytest.raises(ValueError):
        live.stream_indicators(bars(spark, [1]), sma=0)


def test_bucketed_upsert_does_not_shuffle_what_is_stored(spark):
    from tidemark.sources import buckets

    old = bars(spark, range(60), key="a").unionByName(bars(spark, range(9), key="b"))
    new = bars(spark, range(100, 130), key="a").withColumn("open_time", F.col("open_time") + F.expr("interval 45 minutes"))
    twice = new.unionByName(new.withColumns({"arrival": F.col("arrival") + 1000, "close": (F.col("close") + 1).cast("decimal(18,8)"), "volume": F.lit(None).cast("decimal(18,8)")}))
    name = buckets.create(old.drop("arrival"), buckets=16)
    table = buckets.merged(spark.table(name), twice)
    expected = store.upsert(old.drop("arrival"), twice)
    assert sorted(map(str, table.collect())) == sorted(map(str, expected.select(table.columns).collect()))
    plan = table._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
    scan = next(line for line in plan.splitlines() if name in line)
    assert "Bucketed: true" in scan and "SelectedBucketsCount: 16 out of 16" in plan
    left = [line for line in plan.splitlines() if line.lstrip().startswith(":")]
    assert left and not any("Exchange" in line for line in left)
    after = buckets.upsert(name, twice, buckets=16)
    again = buckets.merged(spark.table(after), twice)
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
    assert spark.table(name).count() == 69
