"""Sequence events across batches equal those of all bars at once, wherever the borders lie."""

from datetime import timedelta

import pytest
from helpers import START, bars
from pyspark.sql import functions as F

from tidemark.operators import continuity, quality
from tidemark.plans import jobs
from tidemark.session import scratch
from tidemark.streaming import bars as bar_streams


def series(spark, key="a"):
    """A gap, a late bar, streaks of 3, 7 and (open) 6, and two price jumps: one after a full window, one too early."""
    closes = [100 + (i * 7 % 5) for i in range(90)]
    closes[12], closes[60] = 900, 900
    volumes = [10] * 90
    for stretch in (range(5, 8), range(30, 37), range(84, 90)):
        for i in stretch:
            volumes[i] = 0
    minutes = [*range(20), *range(25, 95)]
    minutes[50], minutes[51] = minutes[51], minutes[50]
    return bars(spark, closes, key=key, volumes=volumes, times=[START + timedelta(minutes=m) for m in minutes])


def shown(events):
    rows = events.select("instrument_id", "check_name", "open_time", F.coalesce(F.col("details")["streak_length"], F.lit("")).alias("streak")).collect()
    return sorted((r["instrument_id"], r["check_name"], r["open_time"], r["streak"]) for r in rows)


@pytest.fixture(scope="module")
def whole(spark):
    rows = series(spark).unionByName(series(spark, "b").where("arrival < 33")).unionByName(bars(spark, [5], key="c", volumes=[0]))
    return rows, shown(quality.flagged(rows))


def test_events_are_of_every_kind(whole):
    assert {c for _, c, _, _ in whole[1]} == {"missing_interval", "timestamp_monotonic", "zero_volume_streak", "price_move_sigma"}


@pytest.mark.parametrize("cuts", [[31, 36, 61], [6, 20, 60], [51, 87], list(range(28, 40)), [1, 89]])
def test_borders_change_nothing(spark, whole, cuts):
    rows, expected = whole
    tail, seen = None, None
    edges = [0, *cuts, 90]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = rows.where((F.col("arrival") >= low) & (F.col("arrival") < high))
        if n % 2:  # order within a batch is all that counts
            batch = batch.withColumn("arrival", F.col("arrival") - low)
        events, tail = continuity.checked(batch, tail)
        events = events.withColumn("batch_id", F.lit(n))
        seen = events if seen is None else seen.unionByName(events)
        tail = jobs.staged(tail, scratch(spark, "tail"))
        seen = jobs.staged(seen, scratch(spark, "seen"))
        assert tail.groupBy("instrument_id").count().agg(F.max("count")).first()[0] <= 21
    assert shown(continuity.settled(seen)) == expected


@pytest.mark.parametrize("cut", [6, 21, 33, 36, 61, 88])
def test_stored_bars_stand_in_front_of_a_batch(spark, cut):
    rows = series(spark).withColumn("open_time", F.timestamp_micros(F.unix_micros(F.lit(START)) + F.col("arrival") * 60_000_000 + F.when(F.col("arrival") >= 20, 300_000_000).otherwise(0)))
    stored, batch = rows.where(F.col("arrival") < cut), rows.where(F.col("arrival") >= cut)
    events, _ = continuity.checked(batch, continuity.stored_tail(stored, batch))
    first = batch.agg(F.min("open_time")).first()[0]
    assert shown(events) == [e for e in shown(quality.flagged(rows)) if e[2] >= first]
    table = stored.drop("arrival").withColumns({"is_closed": F.lit(True), "source": F.lit("x"), "trade_count": F.lit(1).cast("long")})
    after, log = jobs.validate_and_ingest(batch, table, "test", START + timedelta(days=1))
    assert after.count() == 90
    assert sorted(r["check_name"] for r in log.collect()) == sorted(e[1] for e in shown(events))


def test_stream_of_bars_and_stored_start(spark, whole, tmp_path):
    rows, expected = whole
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 34), (34, 61), (61, 90)):
        rows.where((F.col("arrival") >= low) & (F.col("arrival") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        bar_streams.ingest(stream, out, f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(f"{out}/events")
    found = bar_streams.ingested_events(stored)
    assert shown(found.withColumn("details", F.from_json("details", "map<string,string>"))) == expected
    # A stream that begins in the middle of what is stored says of the rest what the whole says.
    ordered = series(spark).withColumn("open_time", F.timestamp_micros(F.unix_micros(F.lit(START)) + F.col("arrival") * 60_000_000))
    rest = str(tmp_path / "rest")
    ordered.where("arrival >= 34").write.parquet(rest)
    stream = spark.readStream.schema(ordered.schema).parquet(rest)
    bar_streams.ingest(stream, f"{out}2", f"{out}2/checkpoint", stored=ordered.where("arrival < 34")).trigger(availableNow=True).start().awaitTermination()
    late = bar_streams.ingested_events(spark.read.parquet(f"{out}2/events")).withColumn("details", F.from_json("details", "map<string,string>"))
    assert shown(late) == [e for e in shown(quality.flagged(ordered)) if e[2] >= START + timedelta(minutes=34)]


def test_series_without_bars_keep_their_tail(spark):
    rows = series(spark)
    _, tail = continuity.checked(rows.where("arrival < 33"))
    other = bars(spark, [1, 2], key="z")
    _, both = continuity.checked(other, tail)
    assert {r["instrument_id"]: r["count"] for r in both.groupBy("instrument_id").count().collect()} == {"a": 21, "z": 2}
    events, _ = continuity.checked(rows.where("arrival >= 33"), both)
    assert (("a", "zero_volume_streak", START + timedelta(minutes=42), "7")) in shown(events)
    nothing, kept = continuity.checked(rows.where("false"), tail)
    assert nothing.count() == 0 and kept.count() == 21
