"""Cold storage: monthly Parquet partitions, verified by reading back before anything is trimmed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import content_words, row_hash
from tidemark.schemas import MONEY

PARTITIONS = ("dataset", "venue", "symbol", "interval", "year", "month", "batch")
# What the archive stores of each dataset.
CONTENT = {
    "candle": ("instrument_id", "open_time", "open", "high", "low", "close", "volume", "trade_count", "is_closed", "source"),
    "trade_tick": ("instrument_id", "ts", "venue_trade_id", "price", "qty", "side"),
}
TIME = {"candle": "open_time", "trade_tick": "ts"}
RETENTION_DAYS = 90


def is_old(dataset: str, now: datetime, retention_days: int = RETENTION_DAYS, since: datetime | None = None) -> Column:
    """Whether a hot row lies in [since, now - retention)."""
    time = F.col(TIME[dataset])
    old = time < F.lit(now - timedelta(days=retention_days))
    return old & (time >= F.lit(since)) if since is not None else old


def _interval(dataset: str) -> Column:
    return F.col("interval") if dataset == "candle" else F.lit("tick")


def archive_rows(rows: DataFrame, dataset: str, batch: str) -> DataFrame:
    """Rows in archive layout: decimals as text, partition columns derived.

    Needs ``venue`` and ``symbol``. Dataset and interval are part of the path, so candles, ticks and
    different bar sizes never share a file; ``batch`` keeps the work of separate runs apart.
    """
    time = TIME[dataset]
    stored = [F.col(c).cast("string").alias(c) if rows.schema[c].dataType == MONEY else F.col(c) for c in CONTENT[dataset]]
    return rows.select(
        *stored, F.lit(dataset).alias("dataset"), "venue", "symbol", _interval(dataset).alias("interval"),
        F.year(time).alias("year"), F.month(time).alias("month"), F.lit(batch).alias("batch"),
    )


def write(rows: DataFrame, dataset: str, path: str, batch: str) -> None:
    """Write one batch, replacing what an earlier attempt at it left in the same partitions.

    Rows are ranged by partition and time: files are few and sorted, and a large month spreads over many tasks.
    """
    order = [*PARTITIONS, TIME[dataset]]
    laid_out = archive_rows(rows, dataset, batch).repartitionByRange(*order).sortWithinPartitions(*order)
    _replace(laid_out, path, *PARTITIONS)


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write the partitions that ``rows`` touch in place of those that are there; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _read_schema(dataset: str) -> T.StructType:
    kinds = {"open_time": T.TimestampType(), "ts": T.TimestampType(), "trade_count": T.LongType(), "is_closed": T.BooleanType()}
    parts = [T.StructField(p, T.IntegerType() if p in ("year", "month") else T.StringType()) for p in PARTITIONS]
    return T.StructType([*[T.StructField(c, kinds.get(c, T.StringType())) for c in CONTENT[dataset]], *parts])


def read_layout(spark: SparkSession, dataset: str, path: str) -> DataFrame:
    """Everything stored of a dataset, as stored. Filters on partition columns prune files."""
    return spark.read.schema(_read_schema(dataset)).parquet(path).where(F.col("dataset") == dataset)


def read(spark: SparkSession, dataset: str, path: str, report: DataFrame | None = None) -> DataFrame:
    """The verified part of the archive with decimals restored; by default by the verdicts stored with it."""
    report = reported(spark, path) if report is None else report
    good = report.where(F.col("checksum_ok") & (F.col("dataset") == dataset)).select(*PARTITIONS)
    stored = read_layout(spark, dataset, path).join(good, list(PARTITIONS), "left_semi")
    amounts = ("open", "high", "low", "close", "volume", "price", "qty")
    return stored.withColumns({c: F.col(c).cast(MONEY) for c in CONTENT[dataset] if c in amounts})


def fingerprints(laid_out: DataFrame, dataset: str) -> DataFrame:
    """Row count and content hash of every monthly partition of a batch."""
    return laid_out.groupBy(*PARTITIONS).agg(
        F.count(F.lit(1)).alias("row_count"), F.sha2(content_words(row_hash(CONTENT[dataset])), 256).alias("content_hash")
    )


def verify(rows: DataFrame, dataset: str, path: str, batch: str) -> DataFrame:
    """Per month of the batch: does reading back give exactly what was to be written?"""
    wanted = fingerprints(archive_rows(rows, dataset, batch), dataset)
    stored = read_layout(rows.sparkSession, dataset, path).where(F.col("batch") == batch)
    got = fingerprints(stored, dataset).withColumnsRenamed({"row_count": "read_count", "content_hash": "read_hash"})
    same = (F.col("row_count") == F.col("read_count")) & (F.col("content_hash") == F.col("read_hash"))
    return wanted.join(got, list(PARTITIONS), "left").withColumn("checksum_ok", F.coalesce(same, F.lit(False)))


REPORT_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c.endswith("count") else T.StringType()) for c in ("row_count", "content_hash", "read_count", "read_hash")]
    + [T.StructField("checksum_ok", T.BooleanType())]
    + [T.StructField(p, T.IntegerType() if p in ("year", "month") else T.StringType()) for p in PARTITIONS]
)


def reported(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts on everything archived below ``path``: one per dataset, month and batch."""
    return spark.read.schema(REPORT_SCHEMA).parquet(f"{path}_report")


def trim(hot: DataFrame, dataset: str, report: DataFrame, old: Column) -> DataFrame:
    """The hot table without the ``old`` rows of verified months; a failed month stays whole."""
    done = report.where("checksum_ok").select(
        F.col("venue").alias("_v"), F.col("symbol").alias("_s"), F.col("interval").alias("_i"), F.col("year").alias("_y"), F.col("month").alias("_m")
    ).distinct()
    time = TIME[dataset]
    in_month = (
        (F.col("venue") == F.col("_v")) & (F.col("symbol") == F.col("_s")) & (_interval(dataset) == F.col("_i"))
        & (F.year(time) == F.col("_y")) & (F.month(time) == F.col("_m"))
    )
    return hot.join(done, in_month & old, "left_anti")


def archive(
    hot: DataFrame,
    dataset: str,
    path: str,
    batch: str,
    now: datetime,
    retention_days: int = RETENTION_DAYS,
    since: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write the old rows of ``hot``, verify them, log the verdicts, and return (report, trimmed hot).

    The report goes below ``<path>_report`` first and is read from there; each batch has one verdict per month,
    the latest. A batch may be repeated: its months are replaced, not added, and read back once. Rows that have
    been archived and trimmed stay archived if the batch is run again over the trimmed table. The trimmed table
    is a plan: write it to a new location, then switch.
    """
    old = is_old(dataset, now, retention_days, since)
    rows = hot.where(old)
    write(rows, dataset, path, batch)
    _replace(verify(rows, dataset, path, batch), f"{path}_report", *PARTITIONS)
    report = reported(hot.sparkSession, path).where((F.col("batch") == batch) & (F.col("dataset") == dataset))
    return report, trim(hot, dataset, report, old)
