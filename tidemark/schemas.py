"""Table shapes. Prices and quantities are decimal(18,8): products stay exact in decimal(37,16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 8)


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


CANDLE = _fields(
    instrument_id=T.StringType(),
    interval=T.StringType(),
    open_time=T.TimestampType(),
    open=MONEY,
    high=MONEY,
    low=MONEY,
    close=MONEY,
    volume=MONEY,
    trade_count=T.LongType(),
    is_closed=T.BooleanType(),
    source=T.StringType(),
)
TRADE_TICK = _fields(
    instrument_id=T.StringType(),
    ts=T.TimestampType(),
    venue_trade_id=T.StringType(),
    price=MONEY,
    qty=MONEY,
    side=T.StringType(),
)
QUALITY_EVENT = _fields(
    instrument_id=T.StringType(),
    interval=T.StringType(),
    check_name=T.StringType(),
    severity=T.StringType(),
    open_time=T.TimestampType(),
    details=T.MapType(T.StringType(), T.StringType()),
)
# One exchange-info document; prices arrive as strings.
_FILTER = _fields(
    filterType=T.StringType(),
    tickSize=T.StringType(),
    minPrice=T.StringType(),
    maxPrice=T.StringType(),
    stepSize=T.StringType(),
    minQty=T.StringType(),
    maxQty=T.StringType(),
    minNotional=T.StringType(),
)
_SYMBOL = _fields(
    symbol=T.StringType(),
    status=T.StringType(),
    baseAsset=T.StringType(),
    quoteAsset=T.StringType(),
    baseAssetPrecision=T.IntegerType(),
    quoteAssetPrecision=T.IntegerType(),
    filters=T.ArrayType(_FILTER),
)
EXCHANGE_INFO = _fields(
    timezone=T.StringType(),
    serverTime=T.LongType(),
    symbols=T.ArrayType(_SYMBOL),
)
# The parts of a kline frame that are read; `k.x` tells whether the bar is closed. The event time
# `E` is left out: it differs from `e` in case only and is read by path.
KLINE_FRAME = _fields(
    e=T.StringType(),
    s=T.StringType(),
    k=_fields(
        t=T.LongType(),
        i=T.StringType(),
        o=T.StringType(),
        h=T.StringType(),
        l=T.StringType(),
        c=T.StringType(),
        v=T.StringType(),
        x=T.BooleanType(),
    ),
)


def money(column: Column | str) -> Column:
    """To the money type; text that is not a number becomes NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast(MONEY)
