import numpy as np
import pandas as pd
import pytest

from helpers import bars, column
from tidemark.operators import indicators as ind
from tidemark.plans.ordered import BARS

RNG = np.random.default_rng(7)
PRICES = np.round(np.abs(np.cumsum(RNG.normal(0, 3, 700)) + 400), 2)
SMALL = BARS.with_(width=30, block_rows=40)


@pytest.fixture(scope="module")
def walk(spark):
    return bars(spark, PRICES, highs=PRICES + 2, lows=PRICES - 1.5).cache()


def _close(got, want, tolerance=1e-9):
    got = np.array([np.nan if v is None else v for v in got], dtype=float)
    np.testing.assert_allclose(got, np.asarray(want, dtype=float), rtol=tolerance, atol=tolerance)


def test_sma_of_one_to_hundred(spark):
    got = column(ind.sma(bars(spark, range(1, 101)), 20), "sma")
    assert got[:19] == [None] * 19 and got[19] == 10.5 and got[99] == 90.5


@pytest.mark.parametrize("series", [BARS, SMALL])
def test_rolling_indicators_match_pandas(walk, series):
    close = pd.Series(PRICES)
    change = close.diff().fillna(0)
    gain, loss = change.clip(lower=0).rolling(14).mean(), (-change).clip(lower=0).rolling(14).mean()
    ranges = pd.concat([close + 2 - (close - 1.5), (close + 2 - close.shift()).abs(), (close - 1.5 - close.shift()).abs()], axis=1).max(axis=1)
    returns = close.pct_change().fillna(0)
    got = ind.panel(walk, series=series)
    _close(column(got, "sma"), close.rolling(20).mean())
    _close(column(got, "rsi"), 100 * gain / (gain + loss))
    _close(column(got, "atr"), ranges.rolling(14).mean())
    _close(column(got, "bb_upper"), close.rolling(20).mean() + 2 * close.rolling(20).std())
    _close(column(got, "volatility"), returns.rolling(20).std() * np.sqrt(252), 1e-7)


def test_panel_equals_single_indicators(walk):
    whole = ind.panel(walk)
    for name, one in {
        "sma": ind.sma(walk, 20), "rsi": ind.rsi(walk), "atr": ind.atr(walk), "bb_lower": ind.bollinger(walk), "volatility": ind.rolling_volatility(walk, 20)
    }.items():
        _close(column(one, name), column(whole, name) if None not in column(whole, name) else [np.nan if v is None else v for v in column(whole, name)])


@pytest.mark.parametrize("span", [1, 2, 3, 12, 200])
def test_ema_matches_pandas(walk, span):
    _close(column(ind.ema(walk, span, series=SMALL), "ema"), pd.Series(PRICES).ewm(span=span, adjust=False).mean(), 1e-11)


@pytest.mark.parametrize("spans", [(12, 26, 9), (1, 5, 3), (2, 400, 2)])
def test_macd_matches_pandas(walk, spans):
    smooth = lambda x, s: x.ewm(span=s, adjust=False).mean()
    close = pd.Series(PRICES)
    line = smooth(close, spans[0]) - smooth(close, spans[1])
    got = ind.macd(walk, *spans, series=SMALL)
    _close(column(got, "macd"), line)
    _close(column(got, "macd_signal"), smooth(line, spans[2]))
    _close(column(got, "macd_hist"), line - smooth(line, spans[2]))


def test_short_blocks_carry_exactly(spark):
    # Span 2 has blocks of a few hundred rows: several borders within 5000 bars.
    prices = np.round(np.abs(np.cumsum(np.random.default_rng(3).normal(0, 1, 5_000)) + 100), 2)
    got = column(ind.ema(bars(spark, prices), 2), "ema")
    _close(got, pd.Series(prices).ewm(span=2, adjust=False).mean(), 1e-11)


def test_flat_prices(spark):
    flat = bars(spark, [5] * 30)
    assert column(ind.rsi(flat), "rsi")[13:] == [50.0] * 17
    assert column(ind.rolling_volatility(flat, 2), "volatility")[1:] == [0.0] * 29


def test_zero_price_gives_null_return(spark):
    got = column(ind.rolling_volatility(bars(spark, [0, 1, 2, 3, 4]), 2), "volatility")
    assert got[0] is None and got[3] is not None


@pytest.mark.parametrize(
    "call",
    [
        lambda b: ind.sma(b, 0), lambda b: ind.ema(b, 0), lambda b: ind.rsi(b, 0), lambda b: ind.atr(b, 0), lambda b: ind.bollinger(b, 1),
        lambda b: ind.macd(b, 26, 12), lambda b: ind.macd(b, 12, 26, 0), lambda b: ind.rolling_volatility(b, 1),
    ],
)
def test_bad_periods_raise(walk, call):
    with pytest.raises(ValueError):
        call(walk)
