"""Would each order fill on its next bar, at what price and fee, or why not."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import plus_seconds
from tidemark.functions.money import FeeSchedule, SlippageModel, half_spread_plus_impact, slipped_price
from tidemark.schemas import MONEY

# Outcomes.
FILLED, PARTIAL, NO_VOLUME = "filled", "partially_filled", "no_fill"
PRECISION, MIN_NOTIONAL, MARGIN, INVALID = "precision", "min_notional", "insufficient_margin", "invalid"


def evaluate_orders(
    orders: DataFrame,
    schedule: FeeSchedule,
    slippage: SlippageModel = half_spread_plus_impact,
    max_volume_fraction: Decimal = Decimal(1),
    latency_seconds: Column | int = 0,
    strict: bool = False,
) -> DataFrame:
    """Add outcome, fill_qty, fill_price, notional, fee, fill_ts and remaining_qty.

    ``orders`` carry side, qty, filled_qty, lot_size, min_notional, spread, volatility,
    available_balance, balance_currency, quote_currency, is_maker, thirty_day_volume and ``bar``,
    the struct of the next bar. Checks run in this order: precision, volume, minimum notional,
    margin. A bar without volume is no rejection: the order stays open. Nonsensical inputs are
    reported as invalid, or raise when ``strict``.
    """
    remaining = (F.col("qty") - F.col("filled_qty")).cast(MONEY)
    nonsense = (
        (remaining <= 0) | (F.col("spread") < 0) | (F.col("volatility") < 0)
        | (F.col("balance_currency") != F.col("quote_currency"))
    )
    if strict:
        nonsense = F.when(nonsense, F.raise_error(F.lit("order cannot be evaluated")).cast("boolean")).otherwise(False)
    volume = F.col("bar.volume")
    share = F.when(volume > 0, F.try_divide(F.col("_remaining").cast("double"), volume.cast("double"))).otherwise(0.0)
    slip = slippage(F.col("spread").cast("double"), share, F.col("volatility").cast("double")).cast(MONEY)
    sized = (
        orders.withColumn("_remaining", remaining)
        .withColumn("_fillable", F.least(F.col("_remaining"), (volume * F.lit(max_volume_fraction)).cast(MONEY)))
        .withColumn("_price", slipped_price(F.col("bar.open"), F.col("side"), slip).cast(MONEY))
        .withColumn("_notional", F.col("_fillable") * F.col("_price"))
    )
    outcome = (
        F.when(nonsense, INVALID)
        .when(F.col("_remaining") % F.col("lot_size") != 0, PRECISION)
        .when(F.col("_fillable") <= 0, NO_VOLUME)
        .when(F.col("_notional") < F.col("min_notional"), MIN_NOTIONAL)
        .when(F.col("_notional") > F.col("available_balance"), MARGIN)
        .when(F.col("_fillable") < F.col("_remaining"), PARTIAL)
        .otherwise(FILLED)
    )
    decided = sized.withColumn("outcome", outcome)
    filled = F.col("outcome").isin(FILLED, PARTIAL)
    rate = schedule.rate("thirty_day_volume", "is_maker")
    latency = F.lit(latency_seconds) if isinstance(latency_seconds, int) else latency_seconds
    return decided.select(
        *orders.columns,
        "outcome",
        F.when(filled, F.col("_fillable")).alias("fill_qty"),
        F.when(filled, F.col("_price")).alias("fill_price"),
        F.when(filled, F.col("_notional")).alias("notional"),
        F.when(filled, F.col("_notional") * rate).alias("fee"),
        F.when(filled, plus_seconds(F.col("bar.open_time"), latency)).alias("fill_ts"),
        F.when(filled, F.col("_remaining") - F.col("_fillable")).otherwise(F.col("_remaining")).cast(MONEY).alias("remaining_qty"),
    )
