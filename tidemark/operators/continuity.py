"""Sequence checks that go on where the bars before a batch ended.

What a series hands on is its *tail*: its last bars, how many zero-volume bars lead up to each, and its place in the
series. Checks see the tail in front of a batch and report events of the batch only, so that a gap, a streak or a
price window across the border is found as if the bars had come at once. A tail has a bounded number of rows per series;
it is written by one batch and read by the next, or looked up among stored bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import quality
from tidemark.plans.ordered import POSITION, Measure, Series, tidy
from tidemark.session import scratch

KEYS = ("instrument_id", "interval")
# ``back`` counts from 1 at the newest bar; ``zeros`` is the run of zero-volume bars that ends at the bar (NULL: not needed).
TAIL = (*KEYS, "open_time", "close", "volume", "back", "zeros", "place")
_SEQ, _PLACE = "_seq", "_place"


def _merged(batch: DataFrame, tail: DataFrame | None, series: Series) -> tuple[DataFrame, Series]:
    """The batch behind the tails of its series, ordered by one integer column."""
    axis = series.order[0]
    timed = isinstance(batch.schema[axis].dataType, T.TimestampType | T.TimestampNTZType)
    at = F.unix_micros(F.col(axis).cast("timestamp")) if timed else F.col(axis).cast("long")
    line = Series(KEYS, (_SEQ,), width=series.width * (1_000_000 if timed else 1), segment_rows=None, block_rows=series.block_rows)
    none = F.lit(None).cast("long")
    rows = batch.select(*KEYS, "open_time", "close", "volume", at.alias(_SEQ), F.lit(False).alias(quality.BEFORE), none.alias("zeros"), none.alias(_PLACE))
    if tail is None:
        return rows, line
    first = rows.groupBy(*KEYS).agg(F.min(_SEQ).alias("_first"))
    before = tail.join(first, list(KEYS)).select(
        *KEYS, "open_time", "close", "volume", (F.col("_first") - F.col("back")).alias(_SEQ), F.lit(True).alias(quality.BEFORE), "zeros", F.col("place").alias(_PLACE)
    )
    return rows.unionByName(before), line


def checked(
    batch: DataFrame, tail: DataFrame | None = None, series: Series = quality.ARRIVALS, streak: int = 5, window: int = 20, sigma: float = 10.0
) -> tuple[DataFrame, DataFrame]:
    """(sequence events of the batch, tails after it).

    Events have two columns more than those of ``quality.flagged``: ``run``, the place in its series where a streak begins
    (NULL for other checks), and ``open``, whether it had not ended with the batch. An open streak is reported again,
    longer or ended, once the series goes on; the later report of a run holds (see ``settled``). Series without a bar in
    the batch keep their tail. Without ``tail`` every series begins with the batch.
    """
    spark = batch.sparkSession
    rows, line = _merged(batch, tail, series)
    walked = line.scan(rows, previous=["open_time"], index=POSITION)
    # The place before the last bar with volume: a tail knows how far back it lies even where its own bars do not reach.
    traded = F.when(F.col("volume") != 0, F.col(POSITION)).when(F.col("zeros").isNotNull(), F.col(POSITION) - F.col("zeros"))
    walked.write.parquet(path := scratch(spark, "walked"))
    walked = spark.read.schema(walked.schema).parquet(path)
    marked = line.running(walked, {"_traded": Measure("max", traded, inclusive=False), "_offset": Measure("max", F.col(_PLACE) - F.col(POSITION))})
    ends = walked.groupBy(*KEYS).agg(F.max(POSITION).alias("_last"))
    marked = marked.join(ends, list(KEYS))
    lead = F.col(POSITION) - 1 - F.coalesce("_traded", F.lit(0))
    marked = marked.withColumns({"lead": lead, "place": F.col(POSITION) + F.coalesce("_offset", F.lit(0)), "back": F.col("_last") - F.col(POSITION) + 1})
    marked.write.parquet(path := scratch(spark, "marked"))
    marked = spark.read.schema(marked.schema).parquet(path)

    ended = F.col("volume") != 0
    length = F.when(ended, F.col("lead")).when((F.col("back") == 1) & (F.col("_last") >= 2), F.col("lead") + 1)
    found = marked.where(~F.col(quality.BEFORE)).withColumn("streak", length).where(F.col("streak") >= max(streak, 1))
    details = F.create_map(F.lit("streak_length"), F.col("streak").cast("string"))
    begins = F.col("place") - F.col("lead")
    streaks = found.select(*quality.event("zero_volume_streak", details), begins.alias("run"), (~ended).alias("open"))
    others = quality.order_violations(walked, line).unionByName(quality.price_moves(walked, window, sigma, line))
    events = streaks.unionByName(others.select("*", F.lit(None).cast("long").alias("run"), F.lit(False).alias("open")))

    zeros = F.when(ended, F.lit(0)).otherwise(F.col("lead") + 1)
    now = marked.where(F.col("back") <= window + 1).select(*KEYS, "open_time", "close", "volume", "back", zeros.cast("long").alias("zeros"), "place")
    if tail is not None:
        now = now.unionByName(tail.join(ends, list(KEYS), "left_anti").select(*TAIL))
    return events, tidy(now.select(*TAIL))


def settled(events: DataFrame, order: str = "batch_id") -> DataFrame:
    """Of all reports of one run the latest; other events as they are."""
    runs = events.where(F.col("run").isNotNull())
    rest = [c for c in events.columns if c not in (*KEYS, "check_name", "run")]
    latest = runs.groupBy(*KEYS, "check_name", "run").agg(F.max_by(F.struct(*rest), order).alias("_e")).select(*KEYS, "check_name", "run", "_e.*")
    return events.where(F.col("run").isNull()).unionByName(latest.select(*events.columns))


def stored_tail(stored: DataFrame, batch: DataFrame, window: int = 20) -> DataFrame:
    """Tails of the stored bars in front of a batch: of each of its series the last bars before the batch's earliest.

    The last bars are picked by a ranked window that Spark cuts before the shuffle, and run lengths by
    aggregates that combine there too: no series is gathered.
    """
    starts = batch.groupBy(*KEYS).agg(F.min("open_time").alias("_start"))
    before = stored.select(*KEYS, "open_time", "close", "volume").join(starts, list(KEYS)).where(F.col("open_time") < F.col("_start")).drop("_start")
    known = before.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("volume") != 0, F.col("open_time"))).alias("_traded"))
    idle = before.join(known, list(KEYS)).where(F.col("_traded").isNull() | (F.col("open_time") > F.col("_traded")))
    idle = idle.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_idle"))
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("open_time"))
    last = before.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= window + 1)
    whole = last.join(known, list(KEYS)).join(idle, list(KEYS), "left")
    back = F.col("back").cast("long")
    zeros = F.coalesce("_idle", F.lit(0)) - back + 1
    return whole.select(
        *KEYS, "open_time", "close", "volume", back.alias("back"), F.when(zeros >= 0, zeros).cast("long").alias("zeros"), (F.col("_n") - back + 1).alias("place")
    )
