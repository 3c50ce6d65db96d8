"""Technical indicators over bar series. Prices are read as doubles; every function adds columns.

Rolling indicators are NULL until enough rows exist; a NaN price affects the windows that contain it and no
others. Exponential ones start at the first price; where a price is NULL or NaN the mean of the prices before
stands, and the next price goes on from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import affine
from tidemark.plans.ordered import BARS, POSITION, Series, tidy


def _at_least(name: str, value: int, least: int) -> None:
    if value < least:
        raise ValueError(f"{name} must be >= {least}")


def _num(column: str) -> Column:
    return F.col(column).cast("double")


def _last_rows(window: Window, n: int) -> Window:
    return window.rowsBetween(-(n - 1), 0)


def _full(window: Window, n: int, value: Column) -> Column:
    """``value`` once n rows of the series exist."""
    return F.when(F.col(POSITION) >= n, value)


# -- rolling ----------------------------------------------------------------------------------


def sma(bars: DataFrame, n: int, price: str = "close", out: str = "sma", series: Series = BARS) -> DataFrame:
    """Mean of the last ``n`` prices."""
    _at_least("sma: period", n, 1)
    return tidy(series.rolling(bars, n - 1, lambda w: _sma_columns(w, n, price, out)))


def _sma_columns(w: Window, n: int, price: str, out: str) -> Mapping[str, Column]:
    return {out: _full(w, n, F.avg(_num(price)).over(_last_rows(w, n)))}


def rsi(bars: DataFrame, n: int = 14, price: str = "close", out: str = "rsi", series: Series = BARS) -> DataFrame:
    """Share of gains among the last ``n`` price changes, in percent; 50 when nothing moved."""
    _at_least("rsi: period", n, 1)
    steps = (lambda w: _change(w, price), lambda w: _rsi_columns(w, n, out))
    return tidy(series.rolling(bars, n, *steps).drop("_change"))


def _change(w: Window, price: str) -> Mapping[str, Column]:
    return {"_change": F.coalesce(_num(price) - F.lag(_num(price)).over(w), F.lit(0.0))}


def _rsi_columns(w: Window, n: int, out: str) -> Mapping[str, Column]:
    change = F.col("_change")
    gain = F.avg(F.greatest(change, F.lit(0.0))).over(_last_rows(w, n))
    loss = F.avg(F.greatest(-change, F.lit(0.0))).over(_last_rows(w, n))
    value = F.when(gain + loss == 0, F.lit(50.0)).otherwise(F.try_divide(100.0 * gain, gain + loss))
    return {out: _full(w, n, value)}


def atr(bars: DataFrame, n: int = 14, out: str = "atr", series: Series = BARS) -> DataFrame:
    """Mean true range of the last ``n`` bars; the first bar's range is high minus low."""
    _at_least("atr: period", n, 1)
    steps = (_true_range, lambda w: _atr_columns(w, n, out))
    return tidy(series.rolling(bars, n, *steps).drop("_range"))


def _true_range(w: Window) -> Mapping[str, Column]:
    before = F.lag(_num("close")).over(w)
    high, low = _num("high"), _num("low")
    return {"_range": F.greatest(high - low, F.abs(high - before), F.abs(low - before))}


def _atr_columns(w: Window, n: int, out: str) -> Mapping[str, Column]:
    return {out: _full(w, n, F.avg("_range").over(_last_rows(w, n)))}


def bollinger(
    bars: DataFrame, n: int = 20, num_std: float = 2.0, price: str = "close", out: str = "bb", series: Series = BARS
) -> DataFrame:
    """``<out>_upper/_middle/_lower``: mean and mean plus/minus sample deviations."""
    _at_least("bollinger: period", n, 2)
    return tidy(series.rolling(bars, n - 1, lambda w: _bollinger_columns(w, n, num_std, price, out)))


def _bollinger_columns(w: Window, n: int, k: float, price: str, out: str) -> Mapping[str, Column]:
    middle = F.avg(_num(price)).over(_last_rows(w, n))
    spread = k * F.stddev_samp(_num(price)).over(_last_rows(w, n))
    return {
        f"{out}_upper": _full(w, n, middle + spread),
        f"{out}_middle": _full(w, n, middle),
        f"{out}_lower": _full(w, n, middle - spread),
    }


def rolling_volatility(
    bars: DataFrame,
    n: int,
    periods_per_year: int = 252,
    price: str = "close",
    out: str = "volatility",
    series: Series = BARS,
) -> DataFrame:
    """Annualised sample deviation of the last ``n`` simple returns.

    The first bar's return is 0 and counts. A return from a zero price is NULL and left out.
    """
    _at_least("rolling_volatility: period", n, 2)
    steps = (lambda w: _simple_return(w, price), lambda w: _volatility_columns(w, n, periods_per_year, out))
    return tidy(series.rolling(bars, n, *steps).drop("_return"))


def _simple_return(w: Window, price: str) -> Mapping[str, Column]:
    before = F.lag(_num(price)).over(w)
    change = F.try_divide(_num(price) - before, before)
    return {"_return": F.when(F.col(POSITION) == 1, F.lit(0.0)).otherwise(change)}


def _volatility_columns(w: Window, n: int, periods: int, out: str) -> Mapping[str, Column]:
    deviation = F.stddev_samp("_return").over(_last_rows(w, n))
    return {out: _full(w, n, deviation * math.sqrt(periods))}


def panel(
    bars: DataFrame,
    sma_n: int = 20,
    rsi_n: int = 14,
    atr_n: int = 14,
    bollinger_n: int = 20,
    volatility_n: int = 20,
    series: Series = BARS,
) -> DataFrame:
    """All rolling indicators on ``close`` in one pass over the series."""
    lookback = max(sma_n - 1, rsi_n, atr_n, bollinger_n - 1, volatility_n)
    first = lambda w: {**_change(w, "close"), **_true_range(w), **_simple_return(w, "close")}
    second = lambda w: {
        **_sma_columns(w, sma_n, "close", "sma"),
        **_rsi_columns(w, rsi_n, "rsi"),
        **_atr_columns(w, atr_n, "atr"),
        **_bollinger_columns(w, bollinger_n, 2.0, "close", "bb"),
        **_volatility_columns(w, volatility_n, 252, "volatility"),
    }
    return tidy(series.rolling(bars, lookback, first, second).drop("_change", "_range", "_return"))


# -- exponential ------------------------------------------------------------------------------
#
# y[i] = r*y[i-1] + a*x[i] with a = 2/(span+1), r = 1-a, y[0] = x[0]; where there is no price, y[i] = y[i-1].
# A segment is one map of the means in front of it to those behind it: y' = decay*y + shift. The signal is a mean of the
# difference of two others, so its map is linear in all three. Maps are chained, one row per segment, and every segment
# is walked from its right start. Spans may be of any length, series of any skew.


def _steps(x: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of a mean over ``x``; NaN is no price."""
    a, there = 2.0 / (span + 1), ~np.isnan(x)
    return np.where(there, 1.0 - a, 1.0), np.where(there, a * np.nan_to_num(x), 0.0)


def _first_price(x: np.ndarray, first: np.ndarray, carried: float) -> np.ndarray:
    """On each row the first price of its group, as far as the batch and what is carried tell; NaN without one."""
    number = np.cumsum(first)
    there = np.flatnonzero(~np.isnan(x))
    found = np.full(number[-1] + 1, np.nan)
    found[number[there[::-1]]] = x[there[::-1]]
    if not first[0] and carried == carried:
        found[0] = carried
    return found[number]


def _chained(bars: DataFrame, price: str, spans: Sequence[int], series: Series) -> tuple[DataFrame, DataFrame]:
    """(bars in segments, per segment the means in front of it ``_s0``... and behind it ``_e0``...).

    One span, or a fast and a slow one and that of the signal of their difference.
    """
    cluster = [*series.keys, series.seg]
    marked = series.segment(bars).withColumn("_x", _num(price))
    places = T.StructType([marked.schema[c] for c in cluster])
    straight = spans[:2]
    figures = [f"{n}{k}" for k in range(len(straight)) for n in ("decay", "shift")] + ["begin"] + (["decay_s", "shift_s", "of_fast", "of_slow"] if len(spans) == 3 else [])

    def running(batch: pa.RecordBatch, first: np.ndarray, carried: np.ndarray) -> np.ndarray:
        (x,) = affine.numbers(batch, "_x")
        known = dict(zip(figures, carried, strict=True))
        paths = {}
        for k, span in enumerate(straight):
            r, term = _steps(x, span)
            paths[f"decay{k}"] = affine.grouped_walk(r, np.zeros(len(x)), first, 1.0, known[f"decay{k}"])
            paths[f"shift{k}"] = affine.grouped_walk(r, term, first, 0.0, known[f"shift{k}"])
        paths["begin"] = _first_price(x, first, known["begin"])
        if len(spans) == 3:
            hole = np.isnan(x)
            line = {"shift_s": paths["shift0"] - paths["shift1"], "of_fast": paths["decay0"], "of_slow": -paths["decay1"]}
            for name, values in line.items():
                paths[name] = affine.grouped_walk(*_steps(np.where(hole, np.nan, values), spans[2]), first, 0.0, known[name])
            r, _ = _steps(x, spans[2])
            paths["decay_s"] = affine.grouped_walk(r, np.zeros(len(x)), first, 1.0, known["decay_s"])
        return np.stack([paths[name] for name in figures], axis=1)

    mapped = T.StructType([*places.fields, *[T.StructField(f"_{c}", T.DoubleType()) for c in figures]])
    narrow = affine.in_groups(marked.select(*cluster, *[c for c in series.order if c not in cluster], "_x"), cluster, series.order)
    maps = narrow.mapInArrow(lambda batches: affine.group_ends(batches, cluster, running, [f"_{c}" for c in figures]), mapped)
    bounds = [f"_{side}{k}" for side in "se" for k in range(len(spans))]
    started = T.StructType([*places.fields, *[T.StructField(c, T.DoubleType()) for c in bounds], T.StructField("_fresh", T.BooleanType())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[float] | None = None
        for batch in batches:
            starts, fresh = [], []
            for begins, row in zip(affine.flags(batch), batch.select([f"_{c}" for c in figures]).to_pylist(), strict=True):
                m = {c: row[f"_{c}"] for c in figures}
                state = None if begins else state
                fresh.append(state is None)
                if state is None and m["begin"] == m["begin"]:
                    # The first price is the first mean, and the first difference of two means is 0.
                    state = [m["begin"]] * len(straight) + [0.0] * (len(spans) - len(straight))
                start = state
                if state is not None:
                    after = [m[f"decay{k}"] * state[k] + m[f"shift{k}"] for k in range(len(straight))]
                    if len(spans) == 3:
                        after.append(m["decay_s"] * state[2] + m["shift_s"] + m["of_fast"] * state[0] + m["of_slow"] * state[1])
                    state = after
                none = [float("nan")] * len(spans)
                starts.append([*(start or none), *(state or none)])
            columns = [pa.array([row[k] for row in starts], pa.float64()) for k in range(len(bounds))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cluster), *columns, pa.array(fresh, pa.bool_())], names=started.fieldNames())

    return marked, affine.in_groups(maps, series.keys, [series.seg]).mapInArrow(chain, started)


def last_means(bars: DataFrame, price: str, spans: Sequence[int], series: Series = BARS) -> DataFrame:
    """Per series the means after its last bar, as ``m0``, ``m1``...: of one span, or of fast, slow and signal; NaN without a price."""
    _, chained = _chained(bars, price, spans, series)
    ends = F.max_by(F.struct(*[F.col(f"_e{k}").alias(f"m{k}") for k in range(len(spans))]), series.seg)
    return chained.groupBy(*series.keys).agg(ends.alias("m")).select(*series.keys, "m.*")


def _means(bars: DataFrame, price: str, spans: Sequence[int], outs: Sequence[str], series: Series) -> DataFrame:
    """Add exponential means of ``price``, or those of fast, slow and signal as line, signal and difference."""
    marked, starts = _chained(bars, price, spans, series)
    cluster, straight = [*series.keys, series.seg], spans[:2]
    starts_of = [f"_s{k}" for k in range(len(spans))]
    kept = [c for c in bars.columns if c not in outs]
    schema = T.StructType([marked.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in outs])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, seen = [0.0] * len(spans), 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            first, fresh = affine.flags(batch), affine.flags(batch, "_fresh")
            x, *begin = affine.numbers(batch, "_x", *starts_of)
            means = [affine.grouped_walk(*_steps(x, span), first, begin[k], carried[k]) for k, span in enumerate(straight)]
            if len(spans) == 3:
                line = np.where(np.isnan(x), np.nan, means[0] - means[1])
                means.append(affine.grouped_walk(*_steps(line, spans[2]), first, begin[2], carried[2]))
            carried = [float(m[-1]) for m in means]
            prices = affine.grouped_walk(np.ones(len(x)), (~np.isnan(x)).astype(float), first, 0.0, seen)
            seen = float(prices[-1])
            none = (fresh & (prices == 0)) | np.isnan(means[0])
            shown = means if len(spans) == 1 else [means[0] - means[1], means[2], means[0] - means[1] - means[2]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(m, mask=none) for m in shown)], names=schema.fieldNames())

    starts = starts.select(*cluster, *starts_of, "_fresh")
    return affine.in_groups(marked.join(starts, cluster), cluster, series.order).mapInArrow(walk, schema)


def ema(bars: DataFrame, span: int, price: str = "close", out: str = "ema", series: Series = BARS) -> DataFrame:
    """Exponential mean with weight 2/(span+1), starting at the first price."""
    _at_least("ema: span", span, 1)
    return _means(bars, price, [span], [out], series)


def macd(
    bars: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    price: str = "close",
    series: Series = BARS,
) -> DataFrame:
    """``macd`` (fast minus slow mean), its ``macd_signal`` and their difference ``macd_hist``."""
    for name, span in (("fast", fast), ("slow", slow), ("signal", signal)):
        _at_least(f"macd: {name} span", span, 1)
    if fast >= slow:
        raise ValueError("macd: fast span must be < slow span")
    return _means(bars, price, [fast, slow, signal], ["macd", "macd_signal", "macd_hist"], series)
