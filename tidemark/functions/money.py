"""Notional, fees, slippage and the one-currency rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import as_column


def notional(qty: Column | str = "qty", price: Column | str = "price") -> Column:
    return as_column(qty) * as_column(price)


def signed_qty(side: Column | str = "side", qty: Column | str = "qty") -> Column:
    qty = as_column(qty)
    return F.when(as_column(side) == "buy", qty).otherwise(-qty)


def single_currency(currency: Column | str = "currency") -> Column:
    """Aggregate: the group's currency; a group that mixes currencies raises."""
    c = as_column(currency)
    mixed = F.concat(F.lit("currency mismatch: "), F.min(c), F.lit(" vs "), F.max(c))
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(
        F.when(F.min(c).isNotNull(), F.raise_error(mixed).cast("string"))
    )


def currency_conflicts(df: DataFrame, keys: Sequence[str], currency: str = "currency") -> DataFrame:
    """Groups whose money may not be added up, with both extremes of the currencies seen."""
    return (
        df.groupBy(*keys)
        .agg(F.min(currency).alias("first_currency"), F.max(currency).alias("last_currency"))
        .where(F.col("first_currency") != F.col("last_currency"))
    )


# -- slippage ---------------------------------------------------------------------------------

SlippageModel = Callable[[Column, Column, Column], Column]


def half_spread_plus_impact(spread: Column, participation: Column, volatility: Column) -> Column:
    """Half the spread plus volatility scaled by the share of the bar's volume."""
    return spread / 2 + participation * volatility


def slipped_price(open_: Column, side: Column, amount: Column) -> Column:
    """The fill price: worse than the open by ``amount``, whichever the side."""
    return F.when(side == "buy", open_ + amount).otherwise(open_ - amount)


# -- fee schedule -----------------------------------------------------------------------------


@dataclass(frozen=True)
class FeeTier:
    threshold: Decimal
    maker_rate: Decimal
    taker_rate: Decimal


@dataclass(frozen=True)
class FeeSchedule:
    """Maker/taker rates by trailing volume. Configuration, so it compiles into a column."""

    tiers: tuple[FeeTier, ...]

    def __post_init__(self) -> None:
        thresholds = [t.threshold for t in self.tiers]
        if not thresholds:
            raise ValueError("fee schedule needs at least one tier")
        if any(isinstance(v, float) for t in self.tiers for v in (t.threshold, t.maker_rate, t.taker_rate)):
            raise TypeError("fee tiers are decimals, not floats")
        if any(min(t.threshold, t.maker_rate, t.taker_rate) < 0 for t in self.tiers):
            raise ValueError("thresholds and rates must be >= 0")
        if 0 not in thresholds:
            raise ValueError("fee schedule needs a base tier (threshold 0)")
        if any(a >= b for a, b in zip(thresholds, thresholds[1:], strict=False)):
            raise ValueError("fee tiers must be strictly ascending by threshold")

    @staticmethod
    def from_frame(tiers: DataFrame, limit: int = 1_000) -> FeeSchedule:
        """Read a tier table with columns threshold, maker_rate, taker_rate."""
        rows = tiers.orderBy("threshold").take(limit + 1)
        if len(rows) > limit:
            raise ValueError(f"a fee schedule has at most {limit} tiers")
        return FeeSchedule(tuple(FeeTier(r.threshold, r.maker_rate, r.taker_rate) for r in rows))

    def _pick(self, volume: Column, value: Callable[[FeeTier], Decimal]) -> Column:
        ladder = F
        for tier in reversed(self.tiers):
            rate = F.lit(value(tier)).cast("decimal(10,8)")
            ladder = ladder.when(volume >= F.lit(tier.threshold), rate)
        return ladder

    def threshold(self, volume: Column | str) -> Column:
        """The threshold of the tier that applies."""
        volume = as_column(volume)
        ladder = F
        for tier in reversed(self.tiers):
            ladder = ladder.when(volume >= F.lit(tier.threshold), F.lit(tier.threshold).cast("double"))
        return ladder

    def rate(self, volume: Column | str, is_maker: Column | str) -> Column:
        """The rate of the highest tier whose threshold ``volume`` reaches."""
        volume = as_column(volume)
        return F.when(as_column(is_maker), self._pick(volume, lambda t: t.maker_rate)).otherwise(
            self._pick(volume, lambda t: t.taker_rate)
        )

    def fee(self, qty: Column, price: Column, volume: Column, is_maker: Column) -> Column:
        return qty * price * self.rate(volume, is_maker)
