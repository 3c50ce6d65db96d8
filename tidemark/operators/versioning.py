"""Dataset versions: what exactly a result was computed on."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import content_words, row_hash
from tidemark.session import scratch
from tidemark.sources.store import insert_if_absent

CANDLE_CONTENT = ("instrument_id", "interval", "open_time", "open", "high", "low", "close", "volume")


def with_row_hash(rows: DataFrame, columns: Sequence[str] = CANDLE_CONTENT) -> DataFrame:
    return rows.withColumn("row_hash", row_hash(columns))


def dataset_versions(
    rows: DataFrame,
    keys: Sequence[str] = (),
    columns: Sequence[str] = CANDLE_CONTENT,
    time: str = "open_time",
    requested: tuple[date, date] | None = None,
) -> DataFrame:
    """One version per key group: symbols, date range, row count and a content hash over all three.

    With ``requested`` (first and last day) only rows of these days count and the range is the requested one, also
    where the data cover less of it; else it is what the data cover. Equal rows give equal hashes in any layout or order; any changed, missing or repeated row gives
    another one.
    """
    first, last = F.min(time).cast("date"), F.max(time).cast("date")
    if requested is not None:
        low, high = requested
        rows = rows.where((F.col(time) >= F.lit(low).cast("timestamp")) & (F.col(time) < F.lit(high + timedelta(days=1)).cast("timestamp")))
        first, last = F.lit(low), F.lit(high)
    grouped = with_row_hash(rows, columns).groupBy(*keys).agg(
        F.array_sort(F.collect_set("instrument_id")).alias("symbol_set"),
        first.alias("date_range_start"),
        last.alias("date_range_end"),
        F.count(F.lit(1)).alias("row_count"),
        content_words(F.col("row_hash")).alias("_words"),
    )
    canonical = F.concat_ws(
        "|", F.concat_ws(",", "symbol_set"), F.col("date_range_start").cast("string"), F.col("date_range_end").cast("string"),
        F.col("row_count").cast("string"), "_words",
    )
    return grouped.withColumn("content_hash", F.sha2(canonical, 256)).drop("_words")


def register(registry: DataFrame, versions: DataFrame, now: Column | datetime) -> DataFrame:
    """New registry rows for versions whose hash is not registered yet."""
    at = now if isinstance(now, Column) else F.lit(now)
    rows = versions.select(
        F.col("content_hash").alias("dataset_version_id"), "content_hash", "symbol_set", "date_range_start", "date_range_end", at.alias("created_at")
    )
    return insert_if_absent(registry, rows, ["content_hash"])


def lookup(registry: DataFrame, dataset_version_id: str) -> DataFrame:
    return registry.where(F.col("dataset_version_id") == dataset_version_id)


# -- trees ---------------------------------------------------------------------------------------
#
# A version as a Merkle tree: rows in order of time make a day of a series, days in order a series, series in order
# the whole. Equal parts have equal hashes, so two versions are compared from the top, and only where they differ.

SERIES = ("instrument_id", "interval")
LEVELS = ("whole", "series", "day")


def _joined_hash(order: Sequence[str], digest: str) -> Column:
    """Aggregate: hash over the digests of a group in order. Groups are bounded: bars of a day, days, series."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(digest).alias("_d"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["_d"]), ""), 256)


def version_tree(rows: DataFrame, columns: Sequence[str] = CANDLE_CONTENT, time: str = "open_time") -> DataFrame:
    """(level, instrument_id, interval, day, hash, row_count) of bars: one row for the whole, per series, and per day of a series.

    Bars lie on a grid, so a day has a bounded number of them; repeated bars count. An empty table gives no rows.
    """
    keys = list(SERIES)
    hashed = with_row_hash(rows, columns).select(*keys, F.col(time).cast("date").alias("day"), time, "row_hash")
    days = hashed.groupBy(*keys, "day").agg(_joined_hash([time], "row_hash").alias("hash"), F.count(F.lit(1)).alias("row_count"))
    days.write.parquet(path := scratch(rows.sparkSession, "leaves"))
    days = rows.sparkSession.read.schema(days.schema).parquet(path)
    named = days.withColumn("_named", F.sha2(F.concat_ws("|", F.col("day").cast("string"), "hash"), 256))
    series = named.groupBy(*keys).agg(_joined_hash(["day"], "_named").alias("hash"), F.sum("row_count").alias("row_count"))
    labelled = series.withColumn("_named", F.sha2(F.concat_ws("|", *keys, "hash"), 256))
    whole = labelled.groupBy().agg(_joined_hash(keys, "_named").alias("hash"), F.sum("row_count").alias("row_count")).where("row_count > 0")
    none = lambda c: F.lit(None).cast(days.schema[c].dataType).alias(c)
    return (
        whole.select(F.lit("whole").alias("level"), none("instrument_id"), none("interval"), none("day"), "hash", "row_count")
        .unionByName(series.select(F.lit("series").alias("level"), *keys, none("day"), "hash", "row_count"))
        .unionByName(days.select(F.lit("day").alias("level"), *keys, "day", "hash", "row_count"))
    )


def store_tree(tree: DataFrame, path: str) -> None:
    """A tree as a table whose levels are folders, so that a comparison reads the days of two versions only where series differ."""
    tree.write.partitionBy("level").parquet(path)


def _level(tree: DataFrame, level: str, *keys: str) -> DataFrame:
    return tree.where(F.col("level") == level).select(*keys, "hash", "row_count")


def _differing(before: DataFrame, after: DataFrame, level: str, *keys: str) -> DataFrame:
    old = _level(before, level, *keys).withColumnsRenamed({"hash": "_old", "row_count": "rows_before"})
    new = _level(after, level, *keys).withColumnsRenamed({"hash": "_new", "row_count": "rows_after"})
    return old.join(new, list(keys), "full").where(~F.col("_old").eqNullSafe(F.col("_new")))


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(instrument_id, interval, day, change, rows_before, rows_after) of every day of a series in which two trees differ.

    ``change`` is added, removed or changed. Days are looked at only for series whose hashes differ, none if there are none.
    """
    series = _differing(before, after, "series", *SERIES).select(*SERIES)
    inside = lambda tree: tree.where(F.col("level") == "day").join(series, list(SERIES), "left_semi")
    days = _differing(inside(before), inside(after), "day", *SERIES, "day")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return days.select(*SERIES, "day", change.alias("change"), count("rows_before"), count("rows_after"))


def changed_rows(before: DataFrame, after: DataFrame, days: DataFrame, columns: Sequence[str] = CANDLE_CONTENT, time: str = "open_time") -> DataFrame:
    """Bars of the differing days that are in one version only, as (change, row): removed or added. Other days are not compared."""
    keys = [*SERIES, "day"]

    def rows(df: DataFrame) -> DataFrame:
        return df.select(*columns).withColumn("day", F.col(time).cast("date")).join(days.select(*keys), keys, "left_semi").select(*columns)

    old, new = rows(before), rows(after)
    gone, come = old.exceptAll(new), new.exceptAll(old)
    return gone.select(F.lit("removed").alias("change"), *columns).unionByName(come.select(F.lit("added").alias("change"), *columns))
