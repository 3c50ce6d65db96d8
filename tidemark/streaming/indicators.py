"""Indicators over a bar stream, equal to the batch forms on the same bars.

State per series is the last few bars and six exponential means, whatever the length of the
stream. Bars must arrive in order between micro-batches (see ``gapgate``); within one they are put in order as
plain arrays, 32 bytes a bar, and walked piece by piece with the state carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import indicators as batch

OUTPUTS = ("sma", "ema", "rsi", "atr", "bb_upper", "bb_middle", "bb_lower", "macd", "macd_signal", "macd_hist", "volatility")
_PIECE = 1 << 16
_STATE = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("low", T.ArrayType(T.DoubleType())),
        T.StructField("close", T.ArrayType(T.DoubleType())),
        T.StructField("means", T.ArrayType(T.DoubleType())),
    ]
)


def _smooth(values: np.ndarray, span: int, start: float | None) -> np.ndarray:
    """Exponential mean that goes on from ``start``, or begins at the first value."""
    if start is None:
        return pd.Series(values).ewm(span=span, adjust=False).mean().to_numpy()
    return pd.Series(np.concatenate([[start], values])).ewm(span=span, adjust=False).mean().to_numpy()[1:]


class IndicatorProcessor(StatefulProcessor):
    def __init__(self, sma: int, ema: int, rsi: int, atr: int, bollinger: int, macd: tuple[int, int, int], volatility: int) -> None:
        self.sma, self.ema, self.rsi, self.atr = sma, ema, rsi, atr
        self.bollinger, self.macd, self.volatility = bollinger, macd, volatility
        self.keep = max(sma - 1, rsi, atr, bollinger - 1, volatility)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("indicator", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(c["open_time"].to_numpy(), c[["high", "low", "close"]].to_numpy(float)) for c in rows]
        times, figures = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(times, kind="stable")
        state = self.state.get() if self.state.exists() else (0, [], [], [], [None] * 4)
        for at in range(0, len(order), _PIECE):
            piece = order[at : at + _PIECE]
            fresh = pd.DataFrame(figures[piece], columns=["high", "low", "close"]).assign(open_time=times[piece])
            result, state = self._walk(key, fresh, state)
            yield result
        self.state.update(state)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        tails = [[float(v) for v in row[c]] for c in ("high", "low", "close")]
        means = [None if m != m else float(m) for m in row["means"]]
        self.state.update((int(row["rows"]), *tails, means))

    def _walk(self, key, fresh: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        """Bars in order, and what has been carried up to them: their indicators, and what is carried on."""
        seen, high, low, close, means = state
        prices = {
            "high": np.concatenate([high, fresh["high"].to_numpy(float)]),
            "low": np.concatenate([low, fresh["low"].to_numpy(float)]),
            "close": np.concatenate([close, fresh["close"].to_numpy(float)]),
        }
        columns = self._rolling(prices, whole=seen <= len(close))
        added = len(fresh)
        out = {name: values[-added:] for name, values in columns.items()}
        values = prices["close"][-added:]
        fast, slow, signal = self.macd
        out["ema"] = _smooth(values, self.ema, means[0])
        quick, late = _smooth(values, fast, means[1]), _smooth(values, slow, means[2])
        out["macd"] = quick - late
        out["macd_signal"] = _smooth(out["macd"], signal, means[3])
        out["macd_hist"] = out["macd"] - out["macd_signal"]
        tails = [prices[c][-self.keep :].tolist() if self.keep else [] for c in ("high", "low", "close")]
        ends = [float(x[-1]) for x in (out["ema"], quick, late, out["macd_signal"])]
        shown = pd.DataFrame({"instrument_id": key[0], "interval": key[1], "open_time": fresh["open_time"].to_numpy(), **{n: out[n] for n in OUTPUTS}})
        return shown, (seen + added, *tails, ends)

    def _rolling(self, prices: dict[str, np.ndarray], whole: bool) -> dict[str, np.ndarray]:
        """Rolling figures over kept and new bars; ``whole`` when no earlier bar was let go."""
        close = pd.Series(prices["close"])
        before = close.shift()
        change = (close - before).fillna(0.0)
        gain = change.clip(lower=0).rolling(self.rsi).mean()
        loss = (-change).clip(lower=0).rolling(self.rsi).mean()
        moved = gain + loss
        ranges = pd.concat(
            [pd.Series(prices["high"] - prices["low"]), (pd.Series(prices["high"]) - before).abs(), (pd.Series(prices["low"]) - before).abs()], axis=1
        ).max(axis=1)
        returns = (close - before) / before.where(before != 0)
        if whole:
            returns.iloc[0] = 0.0
        middle = close.rolling(self.bollinger).mean()
        spread = 2.0 * close.rolling(self.bollinger).std(ddof=1)
        return {
            "sma": close.rolling(self.sma).mean().to_numpy(),
            "rsi": (100.0 * gain / moved.where(moved != 0)).where(moved != 0, 50.0).where(gain.notna()).to_numpy(),
            "atr": ranges.rolling(self.atr).mean().to_numpy(),
            "bb_upper": (middle + spread).to_numpy(),
            "bb_middle": middle.to_numpy(),
            "bb_lower": (middle - spread).to_numpy(),
            "volatility": (returns.rolling(self.volatility).std(ddof=1) * np.sqrt(252)).to_numpy(),
        }

    def close(self) -> None:
        pass


def _ends(stored: DataFrame, processor: IndicatorProcessor) -> DataFrame:
    """Per series what the processor carries after the stored bars: how many there are, the last few, and the means.

    The last bars are picked by a ranked window that Spark cuts before the shuffle; only they are collected.
    """
    keys = ["instrument_id", "interval"]
    bars = stored.select(*keys, "open_time", *[stored[c].cast("double").alias(c) for c in ("high", "low", "close")])
    newest = Window.partitionBy(*keys).orderBy(F.desc("open_time"))
    last = bars.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= max(processor.keep, 1))
    tails = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("open_time", "high", "low", "close"))).alias("t"))
    keep = [F.slice(F.col(f"t.{c}"), F.lit(1), F.lit(processor.keep or 0)).alias(c) for c in ("high", "low", "close")]
    counts = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    single = batch.last_means(bars, "close", [processor.ema]).withColumnRenamed("m0", "e")
    lines = batch.last_means(bars, "close", list(processor.macd))
    joined = counts.join(tails.select(*keys, *keep), keys).join(single, keys).join(lines, keys)
    return joined.select(*keys, "rows", "high", "low", "close", F.array("e", "m0", "m1", "m2").alias("means"))


def stream_indicators(
    bars: DataFrame,
    sma: int = 20,
    ema: int = 12,
    rsi: int = 14,
    atr: int = 14,
    bollinger: int = 20,
    macd: Sequence[int] = (12, 26, 9),
    volatility: int = 20,
    stored: DataFrame | None = None,
) -> DataFrame:
    """All indicators for every bar of a stream (instrument_id, interval, open_time, high, low, close).

    With ``stored``, bars in front of the stream, a series goes on from where its stored bars end as if they had been
    streamed; prices there must not be NULL.
    """
    if min(sma, ema, rsi, atr, *macd) < 1 or min(bollinger, volatility) < 2 or macd[0] >= macd[1]:
        raise ValueError("indicator periods out of range")
    schema = T.StructType([bars.schema[c] for c in ("instrument_id", "interval", "open_time")])
    for name in OUTPUTS:
        schema.add(name, T.DoubleType())
    processor = IndicatorProcessor(sma, ema, rsi, atr, bollinger, tuple(macd), volatility)
    numbers = bars.select("instrument_id", "interval", "open_time", *[bars[c].cast("double").alias(c) for c in ("high", "low", "close")])
    return numbers.groupBy("instrument_id", "interval").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None",
        initialState=None if stored is None else _ends(stored, processor).groupBy("instrument_id", "interval"),
    )
