"""Reading a venue's symbol descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.intervals import as_column
from tidemark.schemas import money

# Filter names that carry the trading rules.
TICK_FILTERS = ("PRICE_FILTER",)
LOT_FILTERS = ("LOT_SIZE",)
NOTIONAL_FILTERS = ("MIN_NOTIONAL", "NOTIONAL")


def map_status(status: Column | str = "status") -> Column:
    """Venue status to ours: TRADING trades, anything else is halted (never delisted)."""
    return F.when(as_column(status) == "TRADING", F.lit("trading")).otherwise(F.lit("halted"))


def is_tradeable(status: Column | str = "status") -> Column:
    return F.coalesce(as_column(status) == "trading", F.lit(False))


def _last_value(filters: Column, kinds: tuple[str, ...], field: str) -> Column:
    hits = F.filter(filters, lambda f: f["filterType"].isin(*kinds) & f[field].isNotNull())
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)[field])


def tick_size(filters: Column | str = "filters") -> Column:
    return money(_last_value(as_column(filters), TICK_FILTERS, "tickSize"))


def lot_size(filters: Column | str = "filters") -> Column:
    return money(_last_value(as_column(filters), LOT_FILTERS, "stepSize"))


def min_notional(filters: Column | str = "filters") -> Column:
    return money(_last_value(as_column(filters), NOTIONAL_FILTERS, "minNotional"))
