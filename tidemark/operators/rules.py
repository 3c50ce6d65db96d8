"""Signal rules that keep state and see their own fills: enter, hold, leave, or be stopped out.

A position is entered on one condition and left on another (so a band between them changes nothing), or when the close
falls to a share of the price the entry was filled at. What a stretch of bars does depends only on the state it begins
in, so each segment is folded into a map of states: one end for beginning flat, one for beginning with an order not
filled yet, and for beginning in a position as many ends as there are record lows before the first bar that leaves
anyway, as the stop level decides at which of them it is sold. Maps are chained, one row per segment, and every segment is
then walked from its right start. Within a segment the walk goes from trade to trade, not from bar to bar.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import affine
from tidemark.plans.ordered import Series

FLAT, ORDERED, HELD = 0, 1, 2
_LOOK = 64
_MAP = ("flat_state", "flat_entry", "ordered_state", "ordered_entry", "left_state", "left_entry", "lows", "low_states", "low_entries")
State = tuple[int, float]


class Stretch:
    """The bars of one segment in order: where to enter and leave, opens and closes."""

    def __init__(self, enter: np.ndarray, leave: np.ndarray, opens: np.ndarray, closes: np.ndarray, floor: float | None) -> None:
        self.n, self.opens, self.closes, self.floor = len(closes), opens, closes, floor
        at = np.arange(self.n)
        following = lambda hit: np.append(np.minimum.accumulate(np.where(hit, at, self.n)[::-1])[::-1], self.n)
        self.next_enter, self.next_leave = following(enter), following(leave)
        self._known: dict[int, State] = {}

    def sold(self, start: int, entry: float) -> int:
        """The first bar from ``start`` that leaves a position, or n."""
        last = int(self.next_leave[start])
        if self.floor is None:
            return last
        level, size = entry * self.floor, _LOOK
        while start < last:
            stop = min(last, start + size)
            hit = self.closes[start:stop] <= level
            if hit.any():
                return start + int(hit.argmax())
            start, size = stop, size * 2
        return last

    def trades(self, start: int, state: State) -> Iterator[tuple[int, int, float | None]]:
        """(bar bought or -1, bar sold or n, entry price or None if it is not filled yet) from a state on."""
        kind, entry = state
        if kind != FLAT:
            entry = float(self.opens[start]) if kind == ORDERED else entry
            out = self.sold(start, entry)
            yield -1, out, entry
            start = out + 1
        while start < self.n and (bought := int(self.next_enter[start])) < self.n:
            entry = float(self.opens[bought + 1]) if bought + 1 < self.n else None
            out = self.sold(bought + 1, entry) if entry is not None else self.n
            yield bought, out, entry
            start = out + 1

    def end(self, start: int) -> State:
        """The state after the last bar, being flat before bar ``start``; trades met before are not followed again."""
        path, result = [], (FLAT, 0.0)
        while start < self.n and (bought := int(self.next_enter[start])) < self.n:
            if bought in self._known:
                result = self._known[bought]
                break
            path.append(bought)
            if bought + 1 == self.n:
                result = (ORDERED, 0.0)
                break
            entry = float(self.opens[bought + 1])
            out = self.sold(bought + 1, entry)
            if out == self.n:
                result = (HELD, entry)
                break
            start = out + 1
        self._known.update(dict.fromkeys(path, result))
        return result

    def map(self) -> tuple:
        """The figures of ``_MAP``. ``left`` is the end for a position no low stops (HELD with NaN: it goes on as it was)."""
        first = float(self.opens[0])
        out = self.sold(0, first)
        ordered = (HELD, first) if out == self.n else self.end(out + 1)
        last = int(self.next_leave[0])
        left = (HELD, float("nan")) if last == self.n else self.end(last + 1)
        lows = np.zeros(0, np.int64)
        if self.floor is not None and last:
            low = np.minimum.accumulate(self.closes[:last])
            lows = np.flatnonzero(np.append(True, low[1:] < low[:-1]))
        ends = [self.end(int(i) + 1) for i in lows]
        return (*self.end(0), *ordered, *left, self.closes[lows].tolist(), [s for s, _ in ends], [e for _, e in ends])


def _after(state: State, row: dict, floor: float | None) -> State:
    """The state behind a segment that begins in ``state``."""
    kind, entry = state
    if kind == FLAT:
        return row["flat_state"], row["flat_entry"]
    if kind == ORDERED:
        return row["ordered_state"], row["ordered_entry"]
    if floor is not None and row["lows"]:
        # Lows fall, so the first at or below the level is found by halving.
        k = bisect_left(row["lows"], -entry * floor, key=lambda low: -low)
        if k < len(row["lows"]):
            return row["low_states"][k], row["low_entries"][k]
    if row["left_state"] == HELD and row["left_entry"] != row["left_entry"]:
        return state
    return row["left_state"], row["left_entry"]


def _stretch(table: pa.Table, axis: str, floor: float | None) -> tuple[Stretch, np.ndarray]:
    """A segment put in order, and that order."""
    order = np.argsort(table.column(axis).cast(pa.int64()).to_numpy(), kind="stable")
    column = lambda name, kind: table.column(name).to_numpy().astype(kind)[order]
    return Stretch(column("_enter", bool), column("_leave", bool), column("_open", float), column("_close", float), floor), order


def with_positions(bars: DataFrame, enter: Column, leave: Column, series: Series, floor: float | None = None) -> DataFrame:
    """Add ``signal``, ``entry`` and ``cause`` to the bars of every series.

    ``signal`` is buy on the bar that enters and sell on the one that leaves. An order fills at the open of the next bar, which
    is ``entry`` from that bar on to the one that sells. ``cause`` of a sale is rule or stop: the close has come down to
    ``floor`` times the entry. A bar that enters while in a position, or leaves while flat, does nothing; conditions that are
    NULL do not hold. A series needs a grid (its segments are bounded) and its axis must be a time.
    """
    keys, axis = list(series.keys), series.order[0]
    cluster = [*keys, series.seg]
    holds = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    marked = series.segment(bars).withColumns({"_enter": holds(enter), "_leave": holds(leave), "_open": F.col("open").cast("double"), "_close": F.col("close").cast("double")})
    narrow = marked.select(*cluster, axis, "_enter", "_leave", "_open", "_close")
    places = T.StructType([narrow.schema[c] for c in cluster])
    kinds = {"state": T.IntegerType(), "entry": T.DoubleType(), "lows": T.ArrayType(T.DoubleType()), "states": T.ArrayType(T.IntegerType()), "entries": T.ArrayType(T.DoubleType())}
    mapped = T.StructType([*places.fields, *[T.StructField(c, kinds[c.split("_")[-1]]) for c in _MAP]])

    def fold(table: pa.Table) -> pa.Table:
        figures = _stretch(table, axis, floor)[0].map()
        types = {"state": pa.int32(), "entry": pa.float64(), "lows": pa.list_(pa.float64()), "states": pa.list_(pa.int32()), "entries": pa.list_(pa.float64())}
        head = table.select(cluster).slice(0, 1)
        for name, value in zip(_MAP, figures, strict=True):
            head = head.append_column(name, pa.array([value], types[name.split("_")[-1]]))
        return head

    maps = narrow.groupBy(*cluster).applyInArrow(fold, mapped)
    started = T.StructType([*places.fields, T.StructField("_state", T.IntegerType()), T.StructField("_entry", T.DoubleType())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = (FLAT, 0.0)
        for batch in batches:
            starts: list[State] = []
            for first, row in zip(affine.flags(batch), batch.select(list(_MAP)).to_pylist(), strict=True):
                state = (FLAT, 0.0) if first else state
                starts.append(state)
                state = _after(state, row, floor)
            arrays = [*(batch.column(c) for c in cluster), pa.array([s for s, _ in starts], pa.int32()), pa.array([e for _, e in starts], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=started.fieldNames())

    starts = affine.in_groups(maps, keys, [series.seg]).mapInArrow(chain, started)
    columns = [c for c in bars.columns if c not in ("signal", "entry", "cause")]
    out = T.StructType([marked.schema[c] for c in columns])
    out = out.add("signal", T.StringType()).add("entry", T.DoubleType()).add("cause", T.StringType())

    def walk(table: pa.Table) -> pa.Table:
        stretch, order = _stretch(table, axis, floor)
        start = (table.column("_state")[0].as_py(), table.column("_entry")[0].as_py())
        signal, entries, cause = np.full(stretch.n, None, object), np.full(stretch.n, np.nan), np.full(stretch.n, None, object)
        for bought, sold, entry in stretch.trades(0, start):
            if bought >= 0:
                signal[order[bought]] = "buy"
            if entry is not None:
                entries[order[bought + 1 : sold + 1]] = entry
            if sold < stretch.n:
                signal[order[sold]] = "sell"
                cause[order[sold]] = "rule" if stretch.next_leave[sold] == sold else "stop"
        result = table.select(columns)
        for name, values, kind in (("signal", signal, pa.string()), ("entry", entries, pa.float64()), ("cause", cause, pa.string())):
            result = result.append_column(name, pa.array(values, kind, mask=np.isnan(entries) if name == "entry" else None))
        return result

    return marked.join(starts, cluster).groupBy(*cluster).applyInArrow(walk, out)


def band_rule(enter: Column, leave: Column, floor: float | None = None, warmup: int = 0, keys: tuple[str, ...] = ("run_id",)) -> Callable[[DataFrame], DataFrame]:
    """A signal rule for ``jobs.backtest`` that keeps state; it does not enter within the first ``warmup`` bars, which fill no order."""
    from tidemark.plans.jobs import RUN_BARS

    def rule(bars: DataFrame) -> DataFrame:
        return with_positions(bars, enter & (F.col("bar_no") > warmup), leave, RUN_BARS.with_(keys=keys), floor)

    return rule
