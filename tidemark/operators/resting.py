"""Orders that stay open: what a bar cannot fill waits for the next ones, first come first served.

A book is a queue. Let A be the running quantity of orders and C the running capacity of bars (their volume times the share
that may be taken). What bars have filled up to t is D(t) = min(A(t), D(t-1) + c(t)), as capacity that finds no order is
lost. Unrolled, D(t) - C(t) is the running minimum of A - C (or 0): sums and a minimum, which segments carry on. Order j
stands for the stretch of quantity from A(j-1) to A(j), bar t for that from D(t-1) to D(t); every overlap is a fill.
Overlaps are found by one walk down the quantity axis, on which an order or a bar holds until the next one begins: no
range join, no loop over orders, no gathered book.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import plus_seconds
from tidemark.functions.money import FeeSchedule, SlippageModel, half_spread_plus_impact, slipped_price
from tidemark.operators.execution import FILLED, INVALID, PARTIAL, PRECISION
from tidemark.plans.ordered import Measure, Series, tidy
from tidemark.schemas import MONEY
from tidemark.session import scratch

OPEN = "open"
BOOK = ("instrument_id", "interval")
# Quantities are counted in units of the last decimal place.
_UNIT = 100_000_000


def _units(quantity: Column) -> Column:
    return F.floor(quantity.cast("decimal(28,8)") * F.lit(_UNIT)).cast("long")


def _remaining() -> Column:
    return (F.col("qty") - F.col("filled_qty")).cast(MONEY)


def _fault() -> Column:
    """Why an order cannot enter the queue; NULL if it can."""
    return F.when((_remaining() <= 0) | _remaining().isNull(), INVALID).when(_remaining() % F.col("lot_size") != 0, PRECISION)


def resting_fills(
    orders: DataFrame,
    bars: DataFrame,
    schedule: FeeSchedule,
    slippage: SlippageModel = half_spread_plus_impact,
    max_volume_fraction: Decimal = Decimal(1),
    latency_seconds: int = 0,
    keys: Sequence[str] = BOOK,
) -> DataFrame:
    """Every fill of every order: its bar, quantity, price, fee and what remains of the order after it.

    ``orders`` carry order_id, ``keys``, placed_at, side, qty, filled_qty, lot_size, spread, volatility, is_maker and
    thirty_day_volume; ``bars`` ``keys``, open_time, open and volume. An order meets bars that open after it was placed, in
    the order of (placed_at, order_id) within a book. Slippage sees what is left of the order as a share of the bar's volume.
    Orders without a remainder, or with one that is no multiple of the lot, take no part. The quantity of a book must stay
    below 92 billion.
    """
    keys, spark = list(keys), orders.sparkSession
    asked = orders.where(_fault().isNull()).withColumn("need", _units(_remaining()))
    wanted = ("order_id", "side", "spread", "volatility", "is_maker", "thirty_day_volume")
    order, bar = F.struct(*wanted), F.struct("open_time", "open", "volume")
    bars = bars.where(F.col("volume") > 0).withColumn("room", _units(F.col("volume") * F.lit(max_volume_fraction))).where("room > 0")
    order_type, bar_type = asked.select(order.alias("x")).schema["x"].dataType, bars.select(bar.alias("x")).schema["x"].dataType
    id_type = asked.schema["order_id"].dataType
    nothing = F.lit(0).cast("long")
    # At one time the bar comes first: it is not for orders placed with it.
    line_of = lambda df, at, kind, need, room, o, b, i: df.select(
        *keys, at.alias("at"), F.lit(kind).alias("kind"), i.alias("id"), need.alias("need"), room.alias("room"), o.alias("order"), b.alias("bar")
    )
    placed = line_of(asked, F.col("placed_at"), 1, F.col("need"), nothing, order, F.lit(None).cast(bar_type), F.col("order_id"))
    opened = line_of(bars, F.col("open_time"), 0, nothing, F.col("room"), F.lit(None).cast(order_type), bar, F.lit(None).cast(id_type))
    line = Series(tuple(keys), ("at", "kind", "id"), width=30 * 86_400)
    summed = line.running(placed.unionByName(opened), {"_need": Measure("sum", F.col("need")), "_room": Measure("sum", F.col("room"))})
    summed.write.parquet(path := scratch(spark, "queue"))
    summed = spark.read.schema(summed.schema).parquet(path)

    ends = summed.where("kind = 1").select(*keys, F.col("_need").alias("x"), (F.col("_need") - F.col("need")).alias("begin"), "order")
    slack = F.col("_need") - F.col("_room")
    served = line.running(summed.where("kind = 0"), {"_now": Measure("min", slack), "_before": Measure("min", slack, inclusive=False)})
    upto = F.col("_room") + F.least(F.col("_now"), nothing)
    after = F.col("_room") - F.col("room") + F.least(F.coalesce("_before", nothing), nothing)
    served = served.select(*keys, upto.alias("x"), after.alias("begin"), "bar").where("x > begin")

    def breaks(df: DataFrame, name: str, other: str, other_type) -> DataFrame:
        return df.select(*keys, "x", F.struct("x", "begin", name).alias(name), F.lit(None).cast(other_type).alias(other))

    held = {n: F.struct("x", "begin", n) for n in ("order", "bar")}
    types = {"order": ends.select(held["order"].alias("s")).schema["s"].dataType, "bar": served.select(held["bar"].alias("s")).schema["s"].dataType}
    both = breaks(ends, "order", "bar", types["bar"]).unionByName(breaks(served, "bar", "order", types["order"]))
    once = both.groupBy(*keys, "x").agg(F.any_value("order", True).alias("order"), F.any_value("bar", True).alias("bar"))
    down = Series(tuple(keys), ("_down",), width=10**12)
    walked = down.running(once.withColumn("_down", -F.col("x")), {"o": Measure("last", F.col("order")), "b": Measure("last", F.col("bar"))})
    met = tidy(walked).where(F.col("b").isNotNull() & F.col("o").isNotNull())

    start = F.greatest("o.begin", "b.begin")
    amount = lambda units: (units.cast("decimal(20,0)") / F.lit(_UNIT)).cast(MONEY)
    filled = met.select(*keys, "o.order.*", "b.bar.*", amount(F.least("o.x", "b.x") - start).alias("fill_qty"), amount(F.col("o.x") - start).alias("_left"))
    share = F.try_divide(F.col("_left").cast("double"), F.col("volume").cast("double"))
    slip = slippage(F.col("spread").cast("double"), share, F.col("volatility").cast("double")).cast(MONEY)
    priced = filled.withColumn("fill_price", slipped_price(F.col("open"), F.col("side"), slip).cast(MONEY))
    return priced.select(
        "order_id",
        *keys,
        "side",
        "open_time",
        plus_seconds("open_time", latency_seconds).alias("fill_ts"),
        "fill_qty",
        "fill_price",
        (F.col("fill_qty") * F.col("fill_price") * schedule.rate("thirty_day_volume", "is_maker")).alias("fee"),
        (F.col("_left") - F.col("fill_qty")).cast(MONEY).alias("remaining_qty"),
    )


def resting_outcomes(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """One row per order: outcome, how much of it was filled in how many bars, and what is still open."""
    taken = fills.groupBy("order_id").agg(F.sum("fill_qty").alias("_taken"), F.count(F.lit(1)).alias("_bars"), F.max("fill_ts").alias("last_fill_ts"))
    filled = F.coalesce("_taken", F.lit(0)).cast(MONEY)
    left = (_remaining() - filled).cast(MONEY)
    outcome = F.coalesce(_fault(), F.when(left == 0, FILLED).when(filled > 0, PARTIAL).otherwise(OPEN))
    return orders.join(taken, "order_id", "left").select(
        *orders.columns, outcome.alias("outcome"), filled.alias("fill_qty"), F.coalesce("_bars", F.lit(0)).cast("long").alias("bars"), "last_fill_ts", left.alias("remaining_qty")
    )
