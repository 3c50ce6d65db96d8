"""Hold bars behind a gap until the missing ones arrive, then release them in order.

Feed it the live stream together with the backfill stream. Every bar comes out once, with a ``status``:

* ``released``  in order, without a gap before it
* ``off_grid``  its open time is no multiple of its interval (counted from 1970-01-01); it fills no slot
* ``early``     it lies before the first slot of its series
* ``repeat``    its slot has been released, or is held already
* ``waiting``   no bar: the slot a series has been waiting for longer than ``patience``

Bars behind a gap are kept in the state store and read slot by slot, so a long outage does not have to fit in memory;
bars in order never touch it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.intervals import step_seconds
from tidemark.schemas import MONEY

FIGURES = ("open", "high", "low", "close", "volume")
_CHUNK = 10_000
_PLACE = T.StructType([T.StructField(c, T.LongType()) for c in ("start_us", "next_us", "held")])
_SLOT = T.StructType([T.StructField("open_us", T.LongType())])
_BAR = T.StructType([T.StructField(c, T.StringType()) for c in FIGURES])
GATED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("instrument_id", "interval")]
    + [T.StructField("open_us", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in (*FIGURES, "status")]
)


class GapGate(StatefulProcessor):
    def __init__(self, patience_ms: int | None) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", _PLACE)
        self.held = handle.getMapState("held", _SLOT, _BAR)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.place.update((int(row["start_us"]), int(row["next_us"]), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.place.exists()
        start, slot, held = self.place.get() if known else (None, None, 0)
        step, out = 0, []
        for chunk in rows:
            step = int(chunk["step_us"].iloc[0])
            fresh: dict[int, tuple] = {}
            for open_us, *bar in chunk[["open_us", *FIGURES]].itertuples(index=False, name=None):
                if open_us % step:
                    out.append((*key, open_us, *bar, "off_grid"))
                elif known and open_us < slot:
                    out.append((*key, open_us, *bar, "early" if open_us < start else "repeat"))
                elif open_us in fresh or (held and self.held.containsKey((open_us,))):
                    out.append((*key, open_us, *bar, "repeat"))
                else:
                    fresh[open_us] = tuple(bar)
            # The first batch decides where a series starts, so it has to be seen whole.
            while known and (slot in fresh or (held and self.held.containsKey((slot,)))):
                slot, held = self._release(key, slot, step, fresh, held, out)
                if len(out) >= _CHUNK:
                    yield _frame(out)
                    out = []
            for open_us, bar in fresh.items():
                self.held.updateValue((int(open_us),), bar)
                start = open_us if start is None else start if known else min(start, open_us)
            held += len(fresh)
            if len(out) >= _CHUNK:
                yield _frame(out)
                out = []
        if not known:
            slot = start
            while held and self.held.containsKey((slot,)):
                slot, held = self._release(key, slot, step, {}, held, out)
                if len(out) >= _CHUNK:
                    yield _frame(out)
                    out = []
        if slot is not None:
            self.place.update((int(start), int(slot), int(held)))
            self._wait(held, timerValues)
        yield _frame(out)

    def _release(self, key, slot: int, step: int, fresh: dict[int, tuple], held: int, out: list) -> tuple[int, int]:
        bar = fresh.pop(slot, None)
        if bar is None:
            bar = self.held.getValue((slot,))
            self.held.removeKey((slot,))
            held -= 1
        out.append((*key, slot, *bar, "released"))
        return slot + step, held

    def _wait(self, held: int, timerValues) -> None:  # noqa: N803
        if self.patience_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, slot, held = self.place.get()
        self._wait(held, timerValues)
        yield _frame([(*key, slot, *[None] * len(FIGURES), "waiting")] if held else [])

    def close(self) -> None:
        pass


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=GATED.fieldNames()).astype({"open_us": "int64"})


def gated(bars: DataFrame, patience_seconds: float | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Bars (instrument_id, interval, open_time and their figures as exact decimals) with their ``status``.

    With ``stored``, bars in front of the stream, a series waits for the slot after its last stored bar; a bar that is
    stored, or lies among stored ones, is a ``repeat``. Other series start at the earliest bar of their first micro-batch.
    Use ``released`` for what may go on.
    """
    rows = bars.select(
        "instrument_id",
        "interval",
        F.unix_micros("open_time").alias("open_us"),
        *[F.col(c).cast("string").alias(c) for c in FIGURES],
        (step_seconds("interval") * 1_000_000).alias("step_us"),
    )
    gate = GapGate(None if patience_seconds is None else int(patience_seconds * 1000))
    done = rows.groupBy("instrument_id", "interval").transformWithStateInPandas(
        statefulProcessor=gate, outputStructType=GATED, outputMode="Append", timeMode="None" if patience_seconds is None else "ProcessingTime",
        initialState=None if stored is None else _places(stored).groupBy("instrument_id", "interval"),
    )
    return done.select("instrument_id", "interval", F.timestamp_micros("open_us").alias("open_time"), *[F.col(c).cast(MONEY).alias(c) for c in FIGURES], "status")


def _places(stored: DataFrame) -> DataFrame:
    """First slot and next slot of every stored series."""
    opened, step = F.unix_micros("open_time"), F.first(step_seconds("interval")) * 1_000_000
    return stored.groupBy("instrument_id", "interval").agg(F.min(opened).alias("start_us"), (F.max(opened) + step).cast("long").alias("next_us"))


def released(bars: DataFrame, patience_seconds: float | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Only what is in order and without a gap."""
    return gated(bars, patience_seconds, stored).where("status = 'released'").drop("status")
