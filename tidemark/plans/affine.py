"""First-order recurrences y_t = a_t * y_(t-1) + b_t over sorted Arrow batches, without a loop over rows.

Affine maps compose, so a stretch of rows is one map. Within a batch, equal stretches are composed side by side, chained
by their ends and run again from their starts; between batches one value is carried. A group of rows begins where its
``first`` flag is set; what a task holds is one batch, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST = "_first"


def walk(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """All y_t, y before the first row being ``start``."""
    n = len(a)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    steps, adds = np.ones(rows * width), np.zeros(rows * width)
    steps[:n], adds[:n] = a, b
    steps, adds = np.ascontiguousarray(steps.reshape(rows, width).T), np.ascontiguousarray(adds.reshape(rows, width).T)
    scale, shift = np.ones(rows), np.zeros(rows)
    for s, t in zip(steps, adds, strict=True):
        scale, shift = s * scale, s * shift + t
    y, starts = start, np.empty(rows)
    for i, (s, t) in enumerate(zip(scale.tolist(), shift.tolist(), strict=True)):
        starts[i] = y
        y = s * y + t
    out, y = np.empty((width, rows)), starts
    for k, (s, t) in enumerate(zip(steps, adds, strict=True)):
        y = s * y + t
        out[k] = y
    return out.T.ravel()[:n]


def grouped_walk(a: np.ndarray, b: np.ndarray, first: np.ndarray, begin: np.ndarray | float, carried: float) -> np.ndarray:
    """As ``walk``, but every group starts from its own ``begin`` (read at its first row); rows before the first flag go on from ``carried``."""
    return walk(np.where(first, 0.0, a), np.where(first, a * begin + b, b), carried)


def before(y: np.ndarray, first: np.ndarray, begin: np.ndarray | float, carried: float) -> np.ndarray:
    """The value in front of each row."""
    return np.where(first, begin, np.concatenate(([carried], y[:-1])))


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as doubles, NULL as NaN."""
    return [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def flags(batch: pa.RecordBatch, name: str = FIRST) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def in_groups(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a group together and in order, the first one flagged: the layout that batches are read in."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(FIRST, F.row_number().over(window) == 1).sortWithinPartitions(*group, *order)


def group_ends(
    batches: Iterator[pa.RecordBatch], group: Sequence[str], running: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], out: Sequence[str]
) -> Iterator[pa.RecordBatch]:
    """One row per group with the last of its ``running`` figures.

    ``running`` gives a row of figures per row of a batch, from the batch, its ``first`` flags and the figures carried so far.
    """
    pending: pa.RecordBatch | None = None
    carried = np.zeros(len(out))

    def rows(keys: pa.RecordBatch, figures: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(f) for f in np.atleast_2d(figures).T)], names=[*group, *out])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        first = flags(batch)
        figures = running(batch, first, carried)
        if first[0] and pending is not None:
            yield rows(pending, carried)
        ends = np.append(np.flatnonzero(first[1:]), len(first) - 1)
        keys = batch.select(list(group))
        if len(ends) > 1:
            yield rows(keys.take(pa.array(ends[:-1])), figures[ends[:-1]])
        pending, carried = keys.slice(int(ends[-1]), 1), figures[ends[-1]]
    if pending is not None:
        yield rows(pending, carried)


def group_maps(batches: Iterator[pa.RecordBatch], group: Sequence[str], inputs: Sequence[str], out: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row per group: the map (a, b) its rows compose to for the average, and (p, q) with gain = p + q * average before it.

    ``inputs`` name keep, add, gain, per_entry and fee; ``out`` the four result columns.
    """

    def row(keys: pa.RecordBatch, figures: np.ndarray) -> pa.RecordBatch:
        arrays = [keys.column(c) for c in group] + [pa.array(f) for f in np.atleast_2d(figures).T]
        return pa.RecordBatch.from_arrays(arrays, names=[*group, *out])

    pending: pa.RecordBatch | None = None
    state = np.array([1.0, 0.0, 0.0, 0.0])
    for batch in batches:
        if batch.num_rows == 0:
            continue
        first = flags(batch)
        keep, add, gain, per_entry, fee = numbers(batch, *inputs)
        if first[0] and pending is not None:
            yield row(pending, state)
        a, b, p, q = state
        scale, shift = grouped_walk(keep, np.zeros(len(keep)), first, 1.0, a), grouped_walk(keep, add, first, 0.0, b)
        gains = gain - per_entry * before(shift, first, 0.0, b) - fee
        slopes = -per_entry * before(scale, first, 1.0, a)
        starts = np.flatnonzero(first)
        edges = starts if first[0] else np.concatenate(([0], starts))
        ends = np.append(edges[1:], len(first)) - 1
        sums, tilts = np.add.reduceat(gains, edges), np.add.reduceat(slopes, edges)
        if not first[0]:
            sums[0] += p
            tilts[0] += q
        figures = np.stack((scale[ends], shift[ends], sums, tilts), axis=1)
        if len(ends) > 1:
            yield row(batch.select(group).take(pa.array(ends[:-1])), figures[:-1])
        pending, state = batch.select(group).slice(int(ends[-1]), 1), figures[-1]
    if pending is not None:
        yield row(pending, state)
