"""Feed supervision: idle symbols and jumps in sequence numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.intervals import plus_seconds
from tidemark.plans.ordered import Series

STALE = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("idle_seconds", T.DoubleType()), T.StructField("detected_at", T.TimestampType())]
)
JUMP = T.StructType(
    [T.StructField("stream", T.StringType()), T.StructField("previous_sequence", T.LongType()), T.StructField("received_sequence", T.LongType())]
)
_MS = T.StructType([T.StructField("ms", T.LongType())])
_SEQ = T.StructType([T.StructField("seq", T.LongType())])


class StalenessProcessor(StatefulProcessor):
    """Raises an event at every check for as long as a symbol stays idle beyond the threshold."""

    def __init__(self, threshold_ms: int, check_ms: int) -> None:
        self.threshold_ms, self.check_ms = threshold_ms, check_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        self.last.update((now,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.threshold_ms + 1)
        yield pd.DataFrame({c: pd.Series(dtype="object") for c in STALE.fieldNames()}).head(0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        idle = now - self.last.get()[0]
        self.handle.registerTimer(now + self.check_ms)
        yield pd.DataFrame({"symbol": [key[0]], "idle_seconds": [idle / 1000.0], "detected_at": [pd.Timestamp(now, unit="ms")]})

    def close(self) -> None:
        pass


def stale_symbols(messages: DataFrame, threshold_seconds: float = 60.0, check_seconds: float = 1.0) -> DataFrame:
    """Staleness events of a live stream with a ``symbol`` column, on the processing clock."""
    processor = StalenessProcessor(int(threshold_seconds * 1000), int(check_seconds * 1000))
    return messages.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=STALE, outputMode="Append", timeMode="ProcessingTime"
    )


_SINCE = T.StructType([T.StructField(c, T.LongType()) for c in ("since_us", "told")])
_TICKS = 50_000


class EventStalenessProcessor(StatefulProcessor):
    """The same watchdog on event time: checks happen every ``check`` after a message, as far as event time has got.

    Between two messages of a symbol the checks are known at once; after its last one a timer tells when the
    watermark, moved on by other symbols, has passed the next check.
    """

    def __init__(self, threshold_us: int, check_us: int) -> None:
        self.check_us, self.first = check_us, threshold_us // check_us + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _SINCE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = np.sort(np.concatenate([c["at_us"].to_numpy(np.int64) for c in rows]))
        since, told = self.last.get() if self.last.exists() else (int(times[0]), self.first - 1)
        for at in times.tolist():
            yield from self._checks(key, since, told, at)
            if at >= since:
                since, told = at, self.first - 1
        self._remember(since, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since, told = self.last.get()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._checks(key, since, told, now)
        self._remember(since, max(told, (now - since) // self.check_us))

    def _checks(self, key, since: int, told: int, until: int) -> Iterator[pd.DataFrame]:
        """Events of the checks after number ``told`` up to ``until``, in frames of bounded size."""
        last = (until - since) // self.check_us
        for low in range(told + 1, last + 1, _TICKS):
            n = np.arange(low, min(low + _TICKS, last + 1))
            at = pd.to_datetime(since + n * self.check_us, unit="us")
            yield pd.DataFrame({"symbol": key[0], "idle_seconds": n * (self.check_us / 1e6), "detected_at": at})

    def _remember(self, since: int, told: int) -> None:
        self.last.update((int(since), int(told)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((since + (told + 1) * self.check_us) // 1000 + 1)

    def close(self) -> None:
        pass


def event_staleness(messages: DataFrame, threshold_seconds: int = 60, check_seconds: int = 1, late: str = "0 seconds") -> DataFrame:
    """Staleness events of a stream (symbol, at) on its own time; ``late`` is how much messages may be out of order."""
    processor = EventStalenessProcessor(threshold_seconds * 1_000_000, check_seconds * 1_000_000)
    timed = messages.select("symbol", "at", F.unix_micros("at").alias("at_us")).withWatermark("at", late)
    return timed.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=STALE, outputMode="Append", timeMode="EventTime"
    )


_ARRIVALS = Series(("symbol",), ("at",), width=86_400)


def recorded_staleness(messages: DataFrame, until: object, threshold_seconds: int = 60, check_seconds: int = 1) -> DataFrame:
    """The same watchdog over recorded messages (symbol, at): the events it would have raised.

    Checks happen every ``check_seconds`` after a message; those later than the threshold and not
    later than the next message (or ``until``) give an event.
    """
    # A closing row per symbol stands for the end of the recording.
    end = messages.select("symbol").distinct().withColumn("at", F.lit(until).cast("timestamp"))
    seen = _ARRIVALS.previous(messages.select("symbol", "at").unionByName(end), ["at"]).where(F.col("prev").isNotNull())
    idle_micros = F.unix_micros("at") - F.unix_micros("prev.at")
    last_check = F.floor(idle_micros / F.lit(check_seconds * 1_000_000)).cast("long")
    first_check = F.lit(threshold_seconds // check_seconds + 1).cast("long")
    checks = seen.where(last_check >= first_check).select("symbol", F.col("prev.at").alias("since"), F.explode(F.sequence(first_check, last_check)).alias("check"))
    idle = F.col("check") * F.lit(check_seconds)
    return checks.select("symbol", idle.cast("double").alias("idle_seconds"), plus_seconds("since", idle).alias("detected_at"))


class SequenceProcessor(StatefulProcessor):
    """Compares each sequence number with the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _SEQ)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(c["arrival"].to_numpy(np.int64), c["seq"].to_numpy(np.int64)) for c in rows]
        arrival, seq = (np.concatenate(x) for x in zip(*parts, strict=True))
        seq = seq[np.argsort(arrival, kind="stable")]
        before = np.concatenate([self.last.get() if self.last.exists() else (seq[0] - 1,), seq[:-1]])
        self.last.update((int(seq[-1]),))
        jumped = seq != before + 1
        yield pd.DataFrame({"stream": key[0], "previous_sequence": before[jumped], "received_sequence": seq[jumped]})

    def close(self) -> None:
        pass


def sequence_jumps(messages: DataFrame) -> DataFrame:
    """Jumps in ``seq`` per ``stream``, messages taken in the order of ``arrival``."""
    return messages.where(F.col("seq").isNotNull()).select("stream", "arrival", "seq").groupBy("stream").transformWithStateInPandas(
        statefulProcessor=SequenceProcessor(), outputStructType=JUMP, outputMode="Append", timeMode="None"
    )
