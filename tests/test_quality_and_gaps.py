from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import START, bars
from tidemark.operators import gaps, quality
from tidemark.plans import jobs


def _checks(df):
    return sorted((r.check_name, r.open_time) for r in df.collect())


def at(i):
    return START + timedelta(minutes=i)


def test_structural_checks(spark):
    b = bars(spark, [100, 100, 100, 100], highs=[101, 99, 101, 101], lows=[99, 98, 99, 99], volumes=[1, 1, -1, 1], times=[at(0), at(1), at(2), at(3) + timedelta(seconds=1)])
    assert _checks(quality.quarantined(b)) == [
        ("ohlc_invariant", at(1)), ("timestamp_alignment", at(3) + timedelta(seconds=1)), ("volume_nonneg", at(2))
    ]
    assert quality.retained(b).count() == 1 and quality.rejected(b).count() == 3


def test_weeks_start_on_thursday(spark):
    monday = bars(spark, [1], interval="1w", times=[START + timedelta(days=4)])
    thursday = bars(spark, [1], interval="1w", times=[START])
    assert quality.quarantined(monday).count() == 1 and quality.quarantined(thursday).count() == 0


def test_unknown_interval_raises(spark):
    with pytest.raises(Exception, match="unsupported candle interval"):
        quality.quarantined(bars(spark, [1], interval="7m")).collect()


def test_price_spike_is_flagged_once_and_kept(spark):
    rng = np.random.default_rng(1)
    closes = list(np.round(100 + rng.uniform(-0.01, 0.01, 25), 6)) + [300, 300]
    b = bars(spark, closes)
    assert [r.open_time for r in quality.price_moves(b).collect()] == [at(25)]
    assert quality.retained(b).count() == 27


def test_price_move_needs_twenty_returns_and_variance(spark):
    assert quality.price_moves(bars(spark, [100] * 21 + [300])).count() == 0
    wobble = [100, 101] * 10
    assert quality.price_moves(bars(spark, wobble + [900])).count() == 0
    assert quality.price_moves(bars(spark, wobble + [100, 900])).count() == 1


def test_zero_volume_streaks(spark):
    ended = bars(spark, [1] * 8, volumes=[1, 0, 0, 0, 0, 0, 3, 1])
    trailing = bars(spark, [1] * 9, key="b", volumes=[1, 1, 1, 0, 0, 0, 0, 0, 0])
    short = bars(spark, [1] * 6, key="c", volumes=[0, 0, 0, 0, 1, 1])
    all_zero = bars(spark, [1] * 5, key="d", volumes=[0] * 5)
    found = quality.zero_volume_streaks(ended.unionByName(trailing).unionByName(short).unionByName(all_zero)).collect()
    assert sorted((r.instrument_id, r.open_time, r.details["streak_length"]) for r in found) == [
        ("a", at(6), "5"), ("b", at(8), "6"), ("d", at(4), "5")
    ]


def test_order_checks_follow_arrival(spark):
    b = bars(spark, [1] * 5, times=[at(0), at(2), at(1), at(1), at(9)])
    assert _checks(quality.order_violations(b)) == [
        ("missing_interval", at(2)), ("missing_interval", at(9)), ("timestamp_monotonic", at(1)), ("timestamp_monotonic", at(1))
    ]


def test_one_bar_has_no_sequence_events(spark):
    assert quality.flagged(bars(spark, [1], volumes=[0]), streak=1).count() == 0


def test_boundary_gap_against_previous_bar(spark):
    before = bars(spark, [1], times=[at(-5)])
    found = quality.boundary_gaps(bars(spark, [1, 1], times=[at(0), at(1)]), before).collect()
    assert [(r.gap_start, r.gap_end) for r in found] == [(at(-5), at(0))]


def _windows(spark, *pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "window_start timestamp, window_end timestamp")


def test_gaps_scattered_contiguous_edges_and_empty_series(spark):
    present = [i for i in range(60) if i not in (0, 7, 8, 9, 30, 59)]
    b = bars(spark, [1] * len(present), times=[at(i) for i in present])
    listed = spark.createDataFrame([("a", "1m"), ("none", "1m")], "instrument_id string, interval string")
    found = gaps.missing_open_times(gaps.gaps(b, at(0), at(59), listed)).collect()
    mine = sorted((r.gap_start, r.gap_end, r.missing_count, len(r.missing_open_times)) for r in found if r.instrument_id == "a")
    assert mine == [(at(0), at(0), 1, 1), (at(7), at(9), 3, 3), (at(30), at(30), 1, 1), (at(59), at(59), 1, 1)]
    assert [r.missing_count for r in found if r.instrument_id == "none"] == [60]


def test_bars_off_the_grid_do_not_fill_slots(spark):
    b = bars(spark, [1, 1], times=[at(0), at(1) + timedelta(seconds=30)])
    assert [r.open_time for r in gaps.missing_slots(b, at(0), at(1)).collect()] == [at(1)]


def test_empty_window_has_no_gaps(spark):
    assert gaps.gaps(bars(spark, [1]), at(5), at(4)).count() == 0


def test_maintenance_overlap_is_closed(spark):
    b = bars(spark, [1] * 5, times=[at(i) for i in (0, 3, 6, 9, 12)])
    found = gaps.gaps(b, at(0), at(12))
    # Gaps: 1-2, 4-5, 7-8, 10-11. Windows touch the end of the first and lie around the third.
    known = gaps.classify(found, _windows(spark, (at(2), at(2)), (at(6), at(9)), (at(0) - timedelta(days=9), at(-1))))
    assert sorted((r.gap_start, r.classification) for r in known.collect()) == [
        (at(1), "maintenance"), (at(4), "unexplained"), (at(7), "maintenance"), (at(10), "unexplained")
    ]


def test_gap_scan_job(spark):
    b = bars(spark, [1, 1], times=[at(0), at(3)])
    known, events, ranges = jobs.gap_scan(b, at(0), at(3), _windows(spark, (at(50), at(51))))
    assert known.count() == 1
    assert events.select("details").head()[0]["missing_count"] == "2"
    assert [(r.range_start, r.range_end) for r in ranges.collect()] == [(at(1), at(2))]
    done = jobs.resume_plan(ranges, jobs.backfill_progress(b.where("false").select("instrument_id", "interval", F.col("open_time").alias("range_start"), F.col("open_time").alias("range_end"), "open_time")))
    assert [(r.resume_from, r.completed) for r in done.collect()] == [(at(1), False)]


def test_ingest_keeps_flagged_and_logs_both(spark):
    batch = bars(spark, [100, 100, 100], highs=[101, 99, 101], times=[at(0), at(1), at(9)])
    stored = batch.drop("arrival").limit(0).withColumns({"trade_count": F.lit(0).cast("long"), "is_closed": F.lit(True), "source": F.lit("")})
    table, log = jobs.validate_and_ingest(batch, stored, "test", at(5))
    assert sorted((r.open_time, r.is_closed) for r in table.collect()) == [(at(0), True), (at(9), False)]
    assert sorted(r.check_name for r in log.collect()) == ["missing_interval", "ohlc_invariant"]
