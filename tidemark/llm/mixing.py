"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import free_name, stored

# A word is a run of other characters than blank and 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
# Expected copies and offsets are whole numbers of this part of a copy, so that prefix sums are exact.
UNIT = 1 << 24
# Parts of a size class within a source: a source's rows are spread over this many times its size classes.
PARTS = 64
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words of a whole text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _even(hex_text: Column, start: int) -> Column:
    """24 bits of an md5 digest as a number."""
    return F.conv(F.substring(hex_text, start, 6), 16, 10).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source: (source, source_size, target).

    Sources in order of their code points, NULL last, take the weights in turn and share ``share`` times all
    sizes in proportion. A target stops at ``most`` times its source's size; what it leaves is shared again by
    weight among the others until none is above. Solved at once: with the sources by size over weight, those
    that stop are the first ones, and the level of the others follows from sums over the order. One row per
    source is ordered, which a list of sources bounds; rows are summed beforehand. Sources of size 0 get 0.
    """
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "whole": F.sum("source_size").over(whole) * F.lit(float(share)),
            "stopped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("whole") - F.col("stopped")) / F.col("left_weight")
    per = per.withColumn("level", level).withColumn("stops", F.col("limit") <= F.col("level") * F.col("weight"))
    # The level of those that do not stop is the one of the first of them.
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)
    per = per.withColumn("final", final["level"])
    target = F.when(F.col("stops") | F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("final") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def copies(
    df: DataFrame, source: str = "source", size: str = "size", id_column: str = "doc_id", expected: str = "expected", out: str = "copies", seed: str = SEED
) -> DataFrame:
    """The rows with how often each is emitted, given the ``expected`` copies of each (a number, NULL counts 0).

    Within a source the expected copies are summed up row by row, one random offset per source is added, and a
    row is emitted once for every whole number its stretch of the sum crosses: its expected copies rounded down or
    up. The order goes by size class, part and size, so that every stretch of sizes gets its share, and ties by id.
    Source, class and part make the segment that one task sums up, so a source with a third of all rows is
    summed by many tasks; only one row per segment goes on to the sum over segments. The offset and the parts follow from
    ``seed``, the source and the ids: reruns agree. Rows alike in source, size and id may swap their numbers.
    NULL sources are one source; NULL sizes are 0; NULL ids come first. All columns are carried along.
    """
    row_size, row_id = F.coalesce(F.col(size), F.lit(0)), F.col(id_column)
    key, part, klass, units, run, total, start = (free_name(df, f"mix_{k}") for k in ("source", "part", "class", "units", "run", "sum", "start"))
    rows = df.withColumns(
        {
            key: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
            klass: F.when(row_size > 0, F.length(F.bin(row_size))).otherwise(0).cast("long"),
            part: _even(F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(row_id.cast("string"), F.lit("null")))), 1) % PARTS,
            units: F.coalesce(F.floor(F.col(expected) * F.lit(float(UNIT)) + 0.5).cast("long"), F.lit(0)),
        }
    )
    segment = [key, klass, part]
    sums = rows.groupBy(*segment).agg(F.sum(units).alias(total))
    offset = _even(F.md5(F.concat_ws("/", F.lit(seed), F.lit("offset"), F.col(key))), 1)
    before = Window.partitionBy(key).orderBy(klass, part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select(*segment, (F.sum(total).over(before) - F.col(total) + offset).alias(start))
    in_segment = Window.partitionBy(*segment).orderBy(row_size, row_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn(run, F.sum(units).over(in_segment)).join(starts, segment)
    end = F.col(start) + F.col(run)
    shift = UNIT.bit_length() - 1
    crossed = F.shiftright(end, shift) - F.shiftright(end - F.col(units), shift)
    return placed.select(*[F.col(f"`{n}`") for n in df.columns], crossed.cast("long").alias(out))


def planned(
    sized: DataFrame, weights: list[float], source: str = "source", size: str = "size", id_column: str = "doc_id", share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The rows with ``mix_source_size``, ``mix_target`` (of their source) and ``mix_copies``: see ``mixed``.

    They replace columns of these names.
    """
    sized = sized.drop("mix_source_size", "mix_target", "mix_copies", "mix_name")
    expected = free_name(sized, "mix_expected")
    per = stored(source_targets(sized, source, size, weights, share, most), "targets")
    per = per.select(F.col("source").alias("mix_name"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rate = F.coalesce(F.try_divide("mix_target", "mix_source_size"), F.lit(0.0))
    named = sized.join(per, F.col(source).eqNullSafe(F.col("mix_name"))).withColumn(expected, rate)
    return copies(named, source, size, id_column, expected, "mix_copies").drop("mix_name", expected)


def mixed(df: DataFrame, weights: list[float], source: str = "source", text: str = "text", id_column: str = "doc_id", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix: every row as often as its copies say, columns as they were.

    Sources get their targets in words (``source_targets``); each row of a source is expected target over
    source size times, so no row comes more than ``most`` times if that is whole. Rows of sources without words are
    not taken. An empty table gives no rows.
    """
    # The row travels as one column, so that none of its names can clash with those used here.
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    rows = df.select(row, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(id_column).alias("doc_id"))
    plan = planned(rows, weights, share=share, most=most).where("mix_copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("row.*")
