"""Instruments: normalise venue documents, merge with drift report, capture the universe."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import venue

INSTRUMENT_COLUMNS = (
    "instrument_id", "venue_id", "symbol", "asset_class", "base_currency", "quote_currency",
    "tick_size", "lot_size", "min_notional", "status", "listed_at", "updated_at",
)
DRIFT_FIELDS = ("tick_size", "lot_size")
_REFRESHED = ("asset_class", "base_currency", "quote_currency", "tick_size", "lot_size", "min_notional", "status")


def _lit(value: Column | datetime | date) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def trading_rules(symbols: DataFrame) -> DataFrame:
    """Add tick_size, lot_size, min_notional and ``missing`` (names of absent rules, NULL if none)."""
    rules = symbols.withColumns(
        {"tick_size": venue.tick_size(), "lot_size": venue.lot_size(), "min_notional": venue.min_notional()}
    )
    absent = F.concat_ws(
        ", ",
        F.when(F.col("tick_size").isNull(), F.lit("PRICE_FILTER.tickSize")),
        F.when(F.col("lot_size").isNull(), F.lit("LOT_SIZE.stepSize")),
        F.when(F.col("min_notional").isNull(), F.lit("MIN_NOTIONAL/NOTIONAL.minNotional")),
    )
    return rules.withColumn("missing", F.nullif(absent, F.lit("")))


def instruments(symbols: DataFrame, venue_id: str) -> DataFrame:
    """Instrument rows of the symbols that carry every rule."""
    good = trading_rules(symbols).where(F.col("missing").isNull())
    return good.select(
        F.lit(venue_id).alias("venue_id"),
        "symbol",
        F.lit("spot").alias("asset_class"),
        F.col("baseAsset").alias("base_currency"),
        F.col("quoteAsset").alias("quote_currency"),
        "tick_size",
        "lot_size",
        "min_notional",
        venue.map_status().alias("status"),
    )


def skipped_symbols(symbols: DataFrame) -> DataFrame:
    """The other symbols with the reason."""
    bad = trading_rules(symbols).where(F.col("missing").isNotNull())
    return bad.select("symbol", F.concat(F.lit("no value in filters for: "), "missing").alias("reason"))


def _paired(existing: DataFrame, incoming: DataFrame, how: str) -> DataFrame:
    old, new = existing.alias("old"), incoming.alias("new")
    same = (F.col("old.venue_id") == F.col("new.venue_id")) & (F.col("old.symbol") == F.col("new.symbol"))
    return old.join(new, same, how)


def merge(existing: DataFrame, incoming: DataFrame, now: Column | datetime) -> DataFrame:
    """The instrument table after an import: last write wins on (venue_id, symbol).

    ``instrument_id`` and ``listed_at`` of known instruments stay; instruments absent from the
    import stay as they are (absence is no delisting). New ids derive from venue and symbol, so a
    re-run task makes the same id.
    """
    both = _paired(existing, incoming, "full_outer")
    new_id = F.md5(F.concat_ws("|", "new.venue_id", "new.symbol"))
    arrived = F.col("new.symbol").isNotNull()
    return both.select(
        F.coalesce(F.col("old.instrument_id"), new_id).alias("instrument_id"),
        F.coalesce("new.venue_id", "old.venue_id").alias("venue_id"),
        F.coalesce("new.symbol", "old.symbol").alias("symbol"),
        *[F.when(arrived, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in _REFRESHED],
        F.coalesce(F.col("old.listed_at"), _lit(now)).alias("listed_at"),
        F.when(arrived, _lit(now)).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


def drift(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per changed tick or lot size of an instrument already known."""
    both = _paired(existing, incoming, "inner")
    changes = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").alias("old"), F.col(f"new.{c}").alias("new"))
            for c in DRIFT_FIELDS
        ]
    )
    rows = both.select(F.col("new.venue_id").alias("venue_id"), F.col("new.symbol").alias("symbol"), F.explode(changes).alias("c"))
    return rows.where(~F.col("c.old").eqNullSafe(F.col("c.new"))).select("venue_id", "symbol", "c.*")


def import_summary(existing: DataFrame, incoming: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: inserted, updated, changed_fields, skipped."""
    known = F.col("old.symbol").isNotNull()
    moved = sum((F.when(known & ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), 1).otherwise(0) for c in DRIFT_FIELDS), F.lit(0))
    counts = _paired(existing, incoming, "right").agg(
        F.count_if(~known).alias("inserted"),
        F.count_if(known).alias("updated"),
        F.coalesce(F.sum(moved), F.lit(0)).cast("long").alias("changed_fields"),
    )
    # Both sides are one-row aggregates.
    one, skips = counts.withColumn("_one", F.lit(1)), skipped.agg(F.count(F.lit(1)).alias("skipped")).withColumn("_one", F.lit(1))
    return one.join(skips, "_one").drop("_one")


# -- universe snapshots -------------------------------------------------------------------------


def universe_snapshot(known: DataFrame, snapshot_date: Column | date, captured_at: Column | datetime) -> DataFrame:
    """One row per instrument of any status."""
    return known.select(
        _lit(snapshot_date).cast("date").alias("snapshot_date"),
        "venue_id",
        "instrument_id",
        venue.is_tradeable().alias("is_tradeable"),
        _lit(captured_at).alias("captured_at"),
    )


def snapshot_summary(snapshot: DataFrame, captured: DataFrame) -> DataFrame:
    """How many rows of ``snapshot`` are new to ``captured`` and how many were there, per date."""
    key = ["snapshot_date", "venue_id", "instrument_id"]
    seen = snapshot.join(captured.select(*key).distinct().withColumn("_there", F.lit(1)), key, "left")
    return seen.groupBy("snapshot_date").agg(
        F.count_if(F.col("_there").isNull()).alias("captured"), F.count_if(F.col("_there").isNotNull()).alias("already_captured")
    )


def tradeable_on(snapshots: DataFrame, day: Column | date) -> DataFrame:
    """Instruments that could be traded on a date, as known then."""
    return snapshots.where((F.col("snapshot_date") == _lit(day)) & F.col("is_tradeable")).select("instrument_id")
