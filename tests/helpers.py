"""Small tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.schemas import MONEY

START = datetime(2026, 1, 1)


def bars(spark, closes, key="a", interval="1m", volumes=None, times=None, highs=None, lows=None, opens=None):
    """One-minute bars with a running ``arrival``."""
    rows = []
    for i, close in enumerate(closes):
        close = Decimal(str(close))
        at = times[i] if times is not None else START + timedelta(minutes=i)
        open_ = Decimal(str(opens[i])) if opens is not None else close
        high = Decimal(str(highs[i])) if highs is not None else max(open_, close) + 1
        low = Decimal(str(lows[i])) if lows is not None else min(open_, close) - 1
        rows.append((key, interval, at, open_, high, low, close, Decimal(str(volumes[i])) if volumes is not None else Decimal(10), i))
    schema = (
        "instrument_id string, interval string, open_time timestamp, open decimal(18,8), high decimal(18,8), low decimal(18,8),"
        " close decimal(18,8), volume decimal(18,8), arrival long"
    )
    return spark.createDataFrame(rows, schema)


def fill_rows(spark, fills, run="r"):
    """Fills from (side, qty, price, fee) tuples, one minute apart."""
    rows = [
        (run, i, START + timedelta(minutes=i), side, Decimal(str(q)), Decimal(str(p)), Decimal(str(fee)), "USDT")
        for i, (side, q, p, fee) in enumerate(fills)
    ]
    return spark.createDataFrame(
        rows, "run_id string, fill_id long, ts timestamp, side string, qty decimal(18,8), price decimal(18,8), fee decimal(18,8), currency string"
    )


def column(df, name, order="open_time"):
    return [r[0] for r in df.orderBy(order).select(F.col(name)).collect()]


__all__ = ["MONEY", "START", "bars", "column", "fill_rows"]
