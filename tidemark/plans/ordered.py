"""Ordered (window-like) work on series whose keys may be badly skewed.

A plain ``Window.partitionBy(key).orderBy(time)`` sends every row of a key to one task, so the
instrument that owns a third of the table decides the run time. The helpers here cut each series
into *segments* (key + slice of the ordering axis) and make the segment, not the key, the unit of
work. What has to cross a segment border is reduced first to one row per segment, and only those
summary rows are ever windowed by key:

* ``scan``      running sums / max / min / last, the row before, the exact position in the series:
                any of them together, with one large shuffle on (key, segment)
* ``rolling``   frames over the last n rows: equal blocks of positions plus an n-row overlap

All of it is ordinary DataFrame code, so Catalyst still prunes, pushes down and code-generates.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.intervals import step_seconds

_SEGMENT = "_segment"
POSITION = "_position"
BLOCK = "_block"
HALO = "_halo"

_SLICES = 10_000
_MICROS = 1_000_000


@dataclass(frozen=True)
class Measure:
    """One running aggregate: ``kind`` is sum, count, max, min or last (last non-null)."""

    kind: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Series:
    """How a table is ordered: its keys, its ordering columns and how finely it is cut.

    ``order`` must be a total order within a key. Its first column is the axis that segments are cut
    on: a timestamp (``width`` in seconds, or in bar steps of the row's ``interval`` when
    ``in_steps``) or an integer (``width`` in its own units). Where the axis
    itself bounds the rows of a segment (bars of a grid, sequence numbers) ``segment_rows`` is None;
    elsewhere a segment with more rows than that is cut into slices of the axis stretch it covers, and
    slices that are still too large are cut once more.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int = 86_400
    segment_rows: int | None = 1_000_000
    block_rows: int = 8_192
    in_steps: bool = False

    def with_(self, **changes: object) -> Series:
        return replace(self, **changes)

    @property
    def seg(self) -> str:
        """The segment column. Its name depends on how the series is cut, so that a tag left by
        another series is never mistaken for this one's."""
        cut = repr((self.keys, self.order[0], self.width, self.segment_rows, self.in_steps))
        return f"{_SEGMENT}_{zlib.crc32(cut.encode()):08x}"

    # -- segments ---------------------------------------------------------------------------

    def segment(self, df: DataFrame) -> DataFrame:
        """Tag each row with the segment it belongs to; segments sort like the axis."""
        if self.seg in df.columns:
            return df
        axis = self.order[0]
        if isinstance(df.schema[axis].dataType, T.TimestampType | T.TimestampNTZType):
            at, width = F.unix_micros(F.col(axis).cast("timestamp")), F.lit(self.width * _MICROS)
        else:
            at, width = F.col(axis).cast("long"), F.lit(self.width)
        if self.in_steps:
            width = width * step_seconds("interval")
        bucket = F.floor(at / width).cast("long")
        if self.segment_rows is None:
            return df.withColumn(self.seg, bucket)
        rows = df.withColumns({"_at": at, "_bucket": bucket})
        first = self._crowded(rows, "_bucket", "_a")
        sliced = self._slice(rows, first, "_bucket", "_a")
        # What is crowded once more can only lie in a crowded bucket. As a rule there is none, and
        # then the inner join with an empty relation costs nothing at run time.
        inside = self._slice(rows, first, "_bucket", "_a", how="inner")
        second = self._crowded(inside, "_bucket_a", "_b")
        tagged = self._slice(sliced, second, "_bucket_a", "_b")
        return tagged.select(*df.columns, F.col("_bucket_a_b").alias(self.seg))

    def _crowded(self, rows: DataFrame, bucket: str, level: str) -> DataFrame:
        """Buckets with more than ``segment_rows`` rows, the stretch of the axis they cover and the
        number of slices to cut it into.

        Each result row stands for more than segment_rows input rows, so there are fewer than
        rows / segment_rows of them; how they are joined is left to Spark, which knows their size at run time.
        """
        counted = rows.groupBy(*self.keys, bucket).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_at").alias(f"_lo{level}"), F.max("_at").alias("_hi")
        )
        slices = F.least(F.ceil(F.col("_n") * F.lit(2.0) / F.lit(self.segment_rows)), F.lit(_SLICES - 1))
        return counted.where(F.col("_n") > self.segment_rows).select(
            *self.keys,
            bucket,
            f"_lo{level}",
            (slices / (F.col("_hi") - F.col(f"_lo{level}") + 1)).alias(f"_per{level}"),
        )

    def _slice(self, rows: DataFrame, crowded: DataFrame, bucket: str, level: str, how: str = "left") -> DataFrame:
        """Number the slices of crowded buckets; the others keep slice 0."""
        joined = rows.join(crowded, [*self.keys, bucket], how)
        slice_no = F.floor((F.col("_at") - F.col(f"_lo{level}")) * F.col(f"_per{level}"))
        tag = F.col(bucket) * F.lit(_SLICES) + F.coalesce(slice_no, F.lit(0)).cast("long")
        return joined.withColumn(f"{bucket}{level}", tag).drop(f"_lo{level}", f"_per{level}")

    # -- operations -------------------------------------------------------------------------

    def scan(
        self,
        df: DataFrame,
        measures: Mapping[str, Measure] | None = None,
        previous: Sequence[str] = (),
        previous_as: str = "prev",
        index: str | None = None,
    ) -> DataFrame:
        """Walk each series in order and add, in one pass:

        * one column per running measure,
        * ``previous_as``: a struct of the ``previous`` columns of the row before (NULL on the first),
        * ``index``: the exact 1-based position.

        One summary row per segment is all that crosses segment borders. Every call reads ``df``
        twice (rows and summary), so ask for everything at once instead of chaining calls.
        """
        df = self.segment(df)
        local = Window.partitionBy(*self.keys, self.seg).orderBy(*self.order)
        segments = Window.partitionBy(*self.keys).orderBy(self.seg)
        before = segments.rowsBetween(Window.unboundedPreceding, -1)
        summary: list[Column] = []
        carry: list[Column] = []
        added: dict[str, Column] = {}
        for name, m in (measures or {}).items():
            summary.append(_summarise(m, self.order).alias(f"_t_{name}"))
            carry.append(_combine(m.kind, F.col(f"_t_{name}")).over(before).alias(f"_c_{name}"))
            frame = local.rowsBetween(Window.unboundedPreceding, 0 if m.inclusive else -1)
            added[name] = _merge(m.kind, F.col(f"_c_{name}"), _within(m).over(frame))
        if previous:
            row = F.struct(*previous)
            summary.append(F.max_by(row, F.struct(*self.order)).alias("_t_row"))
            carry.append(F.lag("_t_row").over(segments).alias("_c_row"))
            added[previous_as] = F.coalesce(F.lag(row).over(local), F.col("_c_row"))
        if index:
            summary.append(F.count(F.lit(1)).alias("_t_n"))
            carry.append(F.sum("_t_n").over(before).alias("_c_n"))
            place = F.coalesce(F.col("_c_n"), F.lit(0)) + F.row_number().over(local)
            added[index] = place.cast("long")
        carries = df.groupBy(*self.keys, self.seg).agg(*summary).select(*self.keys, self.seg, *carry)
        kept = [c for c in df.columns if c not in added]
        # Both sides are clustered on (keys, segment): the rows are shuffled once, by segment.
        joined = df.join(carries, [*self.keys, self.seg], "left")
        return joined.select(*kept, *[c.alias(n) for n, c in added.items()])

    def running(self, df: DataFrame, measures: Mapping[str, Measure]) -> DataFrame:
        """Add running aggregates in series order."""
        return self.scan(df, measures)

    def previous(self, df: DataFrame, columns: Sequence[str], out: str = "prev") -> DataFrame:
        """Add ``out``, a struct of ``columns`` from the row before (NULL on the first row)."""
        return self.scan(df, previous=columns, previous_as=out)

    def index(self, df: DataFrame, out: str = POSITION) -> DataFrame:
        """Add the exact 1-based position of each row in its series."""
        return self.scan(df, index=out)

    def rolling(
        self,
        df: DataFrame,
        lookback: int,
        *steps: Callable[[Window], Mapping[str, Column]],
    ) -> DataFrame:
        """Evaluate frames that reach at most ``lookback`` rows back.

        Each step receives the ordered window and returns columns to add; later steps see the
        columns of earlier ones. Blocks hold ``block_rows`` positions plus the ``lookback`` rows
        before them, so the largest task is bounded whatever the length of the series. Rows that carry
        their POSITION already are not numbered again.
        """
        rows = max(self.block_rows, lookback)
        placed = df if POSITION in df.columns else self.index(df)
        base = [c for c in placed.columns if c not in (self.seg, POSITION)]
        zero_based = F.col(POSITION) - 1
        home = F.floor(zero_based / F.lit(rows)).cast("long")
        near_end = zero_based % F.lit(rows) >= rows - lookback
        targets = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
        spread = placed.select(
            *base, POSITION, F.explode(targets).alias(BLOCK), home.alias("_home")
        ).withColumn(HALO, F.col(BLOCK) != F.col("_home"))
        window = Window.partitionBy(*self.keys, BLOCK).orderBy(POSITION)
        for step in steps:
            spread = spread.withColumns(dict(step(window)))
        return spread.where(~F.col(HALO)).drop(HALO, "_home", BLOCK)


def _summarise(m: Measure, order: Sequence[str]) -> Column:
    if m.kind == "last":
        return F.max_by(m.value, F.when(m.value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[m.kind](m.value)


def _combine(kind: str, total: Column) -> Column:
    if kind == "last":
        return F.last(total, ignorenulls=True)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](total)


def _within(m: Measure) -> Column:
    if m.kind == "last":
        return F.last(m.value, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[m.kind](m.value)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    # greatest / least skip NULLs
    return F.greatest(carry, local) if kind == "max" else F.least(carry, local)


def tidy(df: DataFrame) -> DataFrame:
    """Drop the helper columns."""
    cuts = [c for c in df.columns if c.startswith(_SEGMENT)]
    return df.drop(*cuts, POSITION, BLOCK, HALO)


BARS = Series(("instrument_id", "interval"), ("open_time",), width=8_192, segment_rows=None, in_steps=True)
FILLS = Series(("run_id",), ("ts", "fill_id"), width=365 * 86_400)
EQUITY = Series(("run_id",), ("ts", "seq"), width=30 * 86_400)
