"""Streams of kline frames: closed bars, latest open bars, validated ingest."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.operators import continuity, quality
from tidemark.sources.landing import parse_frames
from tidemark.sources.store import CANDLE_KEY

BAR_KEY = ("symbol", "interval", "open_time")


def closed_bars(frames: DataFrame, repeats_within: str | None = None, received: bool = True) -> DataFrame:
    """Every closed bar of a frame stream, late ones too, with exchange and receive time.

    Bars that are delivered again come again: whoever stores them resolves repeats by key (``stored_once``). With
    ``repeats_within`` the stream itself drops a bar delivered again within that stretch of exchange time; Spark then
    also drops bars that come later than that, which only suits feeds that cannot be that late.
    """
    once = parse_frames(frames).where("is_closed")
    if repeats_within is not None:
        once = once.withWatermark("exchange_ts", repeats_within).dropDuplicatesWithinWatermark(list(BAR_KEY))
    return once.withColumn("local_recv_ts", F.current_timestamp()) if received else once


def stored_once(stored: DataFrame) -> DataFrame:
    """What a stream of closed bars has stored, each bar once: the delivery with the latest exchange time."""
    rest = [c for c in stored.columns if c not in BAR_KEY]
    return stored.groupBy(*BAR_KEY).agg(F.max_by(F.struct(*rest), "exchange_ts").alias("_w")).select(*BAR_KEY, "_w.*")


def latest_open_bars(frames: DataFrame) -> DataFrame:
    """The newest state of the bar still forming, per symbol and interval (update mode)."""
    bars = parse_frames(frames).where(~F.col("is_closed"))
    bar = F.struct("open_time", "open", "high", "low", "close", "volume", "exchange_ts")
    return bars.groupBy("symbol", "interval").agg(F.max_by(bar, F.struct("exchange_ts", "open_time")).alias("bar")).select("symbol", "interval", "bar.*")


def ingest(bars: DataFrame, path: str, checkpoint: str, stored: DataFrame | None = None, **settings: object) -> DataStreamWriter:
    """Split every micro-batch: sound bars to ``<path>/candles``, violations to ``<path>/events``.

    ``bars`` carry ``arrival``, the order in which they came. Sequence checks go on from the micro-batch before, whose tails
    (the last bars of every series) are kept below ``<path>/tails``; a series met for the first time goes on from its
    bars in ``stored``, if given. All output goes to a folder per batch id and replaces it, so a repeated batch
    starts from the same tails and leaves one copy.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            numbered = F.lit(batch_id).cast("long").alias("batch_id")
            quality.retained(batch).select("*", numbered).write.mode("overwrite").parquet(f"{path}/candles/b={batch_id}")
            tail = batch.sparkSession.read.parquet(f"{path}/tails/b={batch_id - 1}") if batch_id else None
            if stored is not None:
                fresh = batch if tail is None else batch.join(tail.select(*continuity.KEYS).distinct(), list(continuity.KEYS), "left_anti")
                looked_up = continuity.stored_tail(stored, fresh, settings.get("window", 20))
                tail = looked_up if tail is None else tail.unionByName(looked_up)
            flags, after = continuity.checked(batch, tail, **settings)
            after.write.mode("overwrite").parquet(f"{path}/tails/b={batch_id}")
            whole = quality.quarantined(batch).select("*", F.lit(None).cast("long").alias("run"), F.lit(False).alias("open")).unionByName(flags)
            whole.select("*", numbered).withColumn("details", F.to_json("details")).write.mode("overwrite").parquet(f"{path}/events/b={batch_id}")
        finally:
            batch.unpersist()

    return bars.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)


def ingested_events(stored: DataFrame) -> DataFrame:
    """The events ``ingest`` stored: those of all bars so far as one batch."""
    return continuity.settled(stored).select(*quality.EVENT_COLUMNS)


def ingested(stored: DataFrame) -> DataFrame:
    """What ``ingest`` stored, last arrival per bar."""
    rest = [c for c in stored.columns if c not in CANDLE_KEY]
    newest = F.max_by(F.struct(*rest), F.struct("batch_id", "arrival"))
    return stored.groupBy(*CANDLE_KEY).agg(newest.alias("_w")).select(*CANDLE_KEY, "_w.*")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet until what is there now has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_update(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every batch of updates below its own folder, replacing it when the batch is repeated."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


