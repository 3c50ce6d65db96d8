"""Reading stored candles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import step_of


@dataclass(frozen=True)
class DatasetVersion:
    symbol_set: tuple[str, ...]
    date_range_start: date
    date_range_end: date


def registered_version(registry: DataFrame, dataset_version_id: str) -> DatasetVersion:
    """The version a registry row describes. One row comes to the driver, with one name per symbol of the set."""
    rows = registry.where(F.col("dataset_version_id") == dataset_version_id).select("symbol_set", "date_range_start", "date_range_end").limit(1).collect()
    if not rows:
        raise ValueError(f"dataset version {dataset_version_id} is not registered")
    return DatasetVersion(tuple(rows[0]["symbol_set"]), rows[0]["date_range_start"], rows[0]["date_range_end"])


def load_version(
    candles: DataFrame, instruments: DataFrame, version: DatasetVersion, intervals: Sequence[str], closed_only: bool = False
) -> DataFrame:
    """Candles of a dataset version with their symbol, whole days at both ends.

    The filters reach the scan; the instruments are one row per member of ``symbol_set``, which Spark
    broadcasts if their size allows. Open bars are included unless ``closed_only``.
    """
    for interval in intervals:
        step_of(interval)
    members = list(version.symbol_set)
    end = version.date_range_end + timedelta(days=1)
    low, high = F.lit(version.date_range_start).cast("timestamp"), F.lit(end).cast("timestamp")
    picked = candles.where(
        F.col("instrument_id").isin(members)
        & F.col("interval").isin(list(intervals))
        & (F.col("open_time") >= low)
        & (F.col("open_time") < high)
    )
    if closed_only:
        picked = picked.where("is_closed")
    names = instruments.where(F.col("id").isin(members)).select(F.col("id").alias("instrument_id"), "symbol")
    return picked.join(names, "instrument_id")
