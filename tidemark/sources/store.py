"""Appending and upserting without a table format: results are new tables, never in-place edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch

CANDLE_KEY = ("instrument_id", "interval", "open_time")


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = CANDLE_KEY, arrival: str = "arrival") -> DataFrame:
    """``existing`` with ``incoming`` written over it: the last arrival of a key wins.

    ``arrival`` orders the incoming rows. The winner is an aggregate that combines map-side, so a
    key repeated any number of times never gathers in one task.
    """
    columns = existing.columns
    rest = [c for c in columns if c not in key]
    old = existing.select(*columns, F.lit(0).alias("_new"), F.lit(None).cast(incoming.schema[arrival].dataType).alias("_arrival"))
    new = incoming.select(*columns, F.lit(1).alias("_new"), F.col(arrival).alias("_arrival"))
    newest = F.max_by(F.struct(*rest), F.struct("_new", "_arrival"))
    return old.unionByName(new).groupBy(*key).agg(newest.alias("_w")).select(*key, "_w.*").select(*columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The incoming rows whose key is not there yet, one per key: the smallest by its other columns, in their order."""
    rest = [c for c in incoming.columns if c not in key]
    once = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_w")).select(*key, "_w.*") if rest else incoming.distinct()
    return once.join(existing.select(*key).distinct(), list(key), "left_anti").select(*incoming.columns)


def upsert_in_place(incoming: DataFrame, path: str, key: Sequence[str] = CANDLE_KEY, arrival: str = "arrival", slot: str = "day", time: str = "open_time") -> None:
    """Write ``incoming`` over the table below ``path``, which is partitioned by (interval, ``slot``).

    Only partitions that hold an incoming key are read, shuffled and written again; they are chosen by the
    partition columns, so the rest of the table is not even listed for reading. The new partitions are written aside
    first and then replace the old ones, so nothing is overwritten while it is read.
    """
    spark = incoming.sparkSession
    placed = incoming.withColumn(slot, F.to_date(time))
    columns = [c for c in placed.columns if c != arrival]
    rest = [c for c in columns if c not in key]
    newest = placed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("_w")).select(*key, "_w.*").select(*columns)
    touched = placed.select("interval", slot).distinct()
    try:
        stored = spark.read.schema(newest.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], newest.schema)
    kept = stored.join(touched, ["interval", slot], "left_semi").join(newest.select(*key), list(key), "left_anti").select(*columns)
    aside = scratch(spark, "upsert")
    kept.unionByName(newest).write.parquet(aside)
    again = spark.read.schema(newest.schema).parquet(aside)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", slot).parquet(path)


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
