"""Segmented scans and blocked frames give what one window over the key gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.ordered import POSITION, Measure, Series, tidy

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    # One key holds most rows and one instant many of them.
    skewed = F.when(F.col("event_id") % 3 < 2, "hot").otherwise(F.col("event_type"))
    burst = F.when(F.col("event_id").between(200, 300), F.lit("2024-01-08 01:00:00").cast("timestamp")).otherwise(F.col("ts"))
    return e.select(skewed.alias("k"), burst.alias("ts"), "event_id", "value").cache()


LAYOUTS = [
    Series(("k",), ("ts", "event_id"), width=86_400 * 400, segment_rows=None),
    Series(("k",), ("ts", "event_id"), width=3_600 * 5, segment_rows=None),
    Series(("k",), ("ts", "event_id"), width=86_400 * 400, segment_rows=7),
    Series((), ("ts", "event_id"), width=86_400, segment_rows=11),
]


def _same(df, other, pairs):
    joined = df.join(other, "event_id")
    assert joined.count() == df.count() == other.count()
    for ours, theirs in pairs:
        assert joined.where(~F.col(ours).eqNullSafe(F.col(theirs))).count() == 0, ours


@pytest.mark.parametrize("series", LAYOUTS)
def test_scan_equals_plain_window(events, series):
    cents = (F.col("value") * 100).cast("long")
    marked = F.when(F.col("value") > 60, F.col("event_id"))
    got = tidy(
        series.scan(
            events,
            {
                "s": Measure("sum", cents),
                "sx": Measure("sum", cents, inclusive=False),
                "c": Measure("count", marked),
                "hi": Measure("max", cents),
                "lo": Measure("min", cents, inclusive=False),
                "seen": Measure("last", marked, inclusive=False),
            },
            previous=["event_id", "value"],
            index="n",
        )
    )
    w = Window.partitionBy(*series.keys).orderBy("ts", "event_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = events.select(
        "event_id",
        F.sum(cents).over(upto).alias("s2"),
        F.sum(cents).over(before).alias("sx2"),
        F.count(marked).over(upto).alias("c2"),
        F.max(cents).over(upto).alias("hi2"),
        F.min(cents).over(before).alias("lo2"),
        F.last(marked, ignorenulls=True).over(before).alias("seen2"),
        F.lag("event_id").over(w).alias("p2"),
        F.row_number().over(w).cast("long").alias("n2"),
    )
    got = got.withColumn("p", F.col("prev.event_id"))
    _same(got, want, [("s", "s2"), ("sx", "sx2"), ("c", "c2"), ("hi", "hi2"), ("lo", "lo2"), ("seen", "seen2"), ("p", "p2"), ("n", "n2")])


@pytest.mark.parametrize("rows", [1, 5, 64, 100_000])
def test_rolling_equals_plain_window(events, rows):
    series = Series(("k",), ("ts", "event_id"), width=86_400, block_rows=rows)
    cents = (F.col("value") * 100).cast("long")
    got = series.rolling(
        events,
        9,
        lambda w: {"before": F.lag(cents, 2).over(w)},
        lambda w: {"m": F.sum(cents).over(w.rowsBetween(-7, 0)), "pos": F.col(POSITION)},
    )
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    want = events.select(
        "event_id", F.lag(cents, 2).over(w).alias("b2"), F.sum(cents).over(w.rowsBetween(-7, 0)).alias("m2"), F.row_number().over(w).cast("long").alias("pos2")
    )
    _same(got, want, [("before", "b2"), ("m", "m2"), ("pos", "pos2")])


def test_hot_bucket_is_split(events):
    series = Series(("k",), ("ts", "event_id"), width=86_400 * 400, segment_rows=20)
    tagged = series.segment(events)
    assert tagged.where("k = 'hot'").select(series.seg).distinct().count() > 10


def test_tags_of_different_series_do_not_mix(events):
    coarse = Series(("k",), ("ts", "event_id"), width=86_400 * 400, segment_rows=None)
    fine = coarse.with_(width=3_600)
    both = fine.index(coarse.index(events, "a"), "b")
    assert both.where("a <> b").count() == 0
