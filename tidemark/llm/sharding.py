"""Sharding by sampled splitters: DataFrame and SQL functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import free_name

# Ranges a shard is cut from, and samples that decide a range's bounds.
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
SEED = 7


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one more; NULL has only the one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def splitters(keyed: DataFrame, key: str, tie: str, size: str, ranges: int) -> tuple[list[tuple[int, int | None]], int]:
    """Range bounds as (key, tie) and the sum of all sizes.

    A row is drawn as often as a deterministic draw, uniform by its key and tie, says of its size in units of
    the mean size of a sample. Every ``SAMPLES_PER_RANGE``-th of the drawn keys in order is a bound. The sample holds about
    ranges times that many rows whatever the size of the table.
    """
    whole = keyed.agg(F.sum(size)).first()[0] or 0
    wanted = ranges * SAMPLES_PER_RANGE
    draw = F.xxhash64(F.lit(SEED), key, tie).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    times = F.floor(F.col(size) * F.lit(wanted / max(whole, 1)) + draw).cast("long")
    drawn = keyed.select(F.struct(F.col(key).alias("k"), F.col(tie).alias("t")).alias("at"), times.alias("times")).where("times > 0")
    upto = F.sum("times").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = F.lit(SAMPLES_PER_RANGE)
    bounds = drawn.select("at", "times", upto.alias("upto")).where(F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("times")) / step))
    return [(row["at"]["k"], row["at"]["t"]) for row in bounds.select("at").distinct().orderBy("at").collect()], whole


def _range_of(key: str, tie: str, bounds: list[tuple[int, int | None]]) -> Column:
    """How many bounds lie at or below the row: a search by halves in a constant array."""
    if not bounds:
        return F.lit(0).cast("long")
    literal = json.dumps([{"k": k, "t": t} for k, t in bounds])
    array = F.from_json(F.lit(literal), "array<struct<k: bigint, t: bigint>>")
    at = F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))
    steps = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(len(bounds).bit_length()))])
    past = lambda done, step: (done + step <= len(bounds)) & (F.get(array, (done + step - 1).cast("int")) <= at)
    return F.aggregate(steps, F.lit(0).cast("long"), lambda done, step: done + F.when(past(done, step), step).otherwise(F.lit(0).cast("long")))


def sharded(
    df: DataFrame, shards: int, text: str = "text", id_column: str = "doc_id", size: str | None = None, key: str | None = None, ranges_per_shard: int = RANGES_PER_SHARD
) -> DataFrame:
    """The rows with ``shard`` (from 0), of sizes as equal as whole rows allow, and ``slot`` (gapless from 0 in the shard).

    Keys: a column of 64-bit numbers, by default a hash of the text, so equal texts stay together as far as sizes
    allow; ties go by id. Splitters from a size-weighted sample of (key, id) cut the order into ranges of
    about equal size, each of which one task puts in order and sums up; as they split by id too, a key that a third of the
    rows share is many ranges. The exact sum of every range then tells where it starts, and a range that is
    overfull, or just lies across, is subdivided where a shard is full: a row goes to the shard in which its first byte falls.
    Only a row per range, and one per range and shard, goes beyond its task.

    Sizes: a column of positive numbers, by default the text's bytes plus one; NULL and negative count 0. NULL texts
    have a key of their own, NULL ids come first, rows alike in key and id may swap places (so repeated rows
    cannot be told apart). An empty table gives no rows. All columns are carried along; ``shard`` and ``slot`` replace
    columns of these names.
    """
    df = df.drop("shard", "slot")
    k, t, s, rng, upto, place, start, first, low, count = (free_name(df, f"shard_{n}") for n in ("key", "tie", "size", "range", "upto", "place", "start", "first", "low", "count"))
    keyed = df.withColumns(
        {
            k: F.col(key) if key else F.xxhash64(F.col(text)),
            t: F.col(id_column).cast("long"),
            s: F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long") if size else byte_size(F.col(text)),
        }
    )
    bounds, whole = splitters(keyed, k, t, s, shards * ranges_per_shard)
    ranged = keyed.withColumn(rng, _range_of(k, t, bounds))
    in_order = Window.orderBy(rng).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = ranged.groupBy(rng).agg(F.sum(s).alias(upto)).select(rng, (F.sum(upto).over(in_order) - F.col(upto)).alias(start))
    inside = Window.partitionBy(rng).orderBy(k, t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({upto: F.sum(s).over(inside), place: F.row_number().over(inside)}).join(starts, rng)
    begins = (F.col(start) + F.col(upto) - F.col(s)).cast("decimal(38,0)")
    shard = F.least(F.floor(begins * shards / F.lit(max(whole, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    placed = summed.withColumn("shard", shard)
    pieces = placed.groupBy(rng, "shard").agg(F.count(F.lit(1)).alias(count), F.min(place).alias(low))
    in_shard = Window.partitionBy("shard").orderBy(rng).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.select(rng, "shard", low, (F.sum(count).over(in_shard) - F.col(count)).alias(first))
    slot = (F.col(first) + F.col(place) - F.col(low)).cast("long")
    return placed.join(pieces, [rng, "shard"]).withColumn("slot", slot).select(*[F.col(f"`{n}`") for n in df.columns], "shard", "slot")


def write(df: DataFrame, path: str, **options) -> None:
    """The shards as files: a folder per shard, rows in slot order within a file."""
    sharded(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
