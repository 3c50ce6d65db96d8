"""Table rules as data: check expressions, unique keys, references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Row rules per table.
CHECKS: dict[str, dict[str, str]] = {
    "candle": {
        "ck_candle_high_vs_open_close": "high >= greatest(open, close)",
        "ck_candle_low_vs_open_close": "low <= least(open, close)",
        "ck_candle_high_vs_low": "high >= low",
        "ck_candle_volume_nonneg": "volume >= 0",
    },
    "trade_tick": {
        "ck_trade_tick_price_positive": "price > 0",
        "ck_trade_tick_qty_positive": "qty > 0",
    },
    "instrument": {
        "ck_instrument_tick_size_positive": "tick_size > 0",
        "ck_instrument_lot_size_positive": "lot_size > 0",
        "ck_instrument_min_notional_positive": "min_notional > 0",
    },
    "strategy_instance": {
        "ck_strategy_instance_allocated_capital_nonneg": "allocated_capital >= 0",
        "ck_strategy_instance_capacity_usd_nonneg": "capacity_usd >= 0",
    },
    "backtest_trade": {
        "ck_backtest_trade_entry_before_exit": "exit_ts IS NULL OR entry_ts < exit_ts",
    },
    "signal": {"ck_signal_strength_bounded": "strength BETWEEN 0 AND 1"},
    "order_intent": {
        "ck_order_intent_target_qty_nonzero": "target_qty <> 0",
        "ck_order_intent_limit_price_required": "order_type <> 'limit' OR limit_price IS NOT NULL",
    },
    "risk_decision": {
        "ck_risk_decision_rejection_reason_required": "approved OR rejection_reason IS NOT NULL",
    },
    "order": {
        "ck_order_filled_qty_le_qty": "filled_qty <= qty",
        "ck_order_filled_qty_nonneg": "filled_qty >= 0",
    },
    "system_halt_event": {
        "ck_system_halt_event_cleared_by_required": "cleared_at IS NULL OR cleared_by IS NOT NULL",
    },
    "fill": {
        "ck_fill_qty_positive": "qty > 0",
        "ck_fill_price_positive": "price > 0",
    },
    "ledger_entry": {"ck_ledger_entry_amount_positive": "amount > 0"},
}
# Keys that must not repeat.
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "candle": (("instrument_id", "interval", "open_time"),),
    "trade_tick": (("instrument_id", "ts", "venue_trade_id"),),
    "instrument": (("venue_id", "symbol"),),
    "universe_snapshot": (("snapshot_date", "venue_id", "instrument_id"),),
    "order": (("venue_id", "client_order_id"),),
    "order_event": (("order_id", "seq"),),
    "fill": (("venue_id", "venue_fill_id"),),
    "position": (("account_id", "instrument_id", "strategy_instance_id"),),
    "risk_decision": (("order_intent_id",),),
    "dataset_version": (("content_hash",),),
    "venue": (("name",),),
    "strategy": (("name", "code_hash"),),
    "account": (("venue_id", "name"),),
    "equity_snapshot": (("id", "ts"),),
}
# Fixed values: (column, referenced table, referenced column).
REFERENCES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "candle": (("instrument_id", "instrument", "id"),),
    "trade_tick": (("instrument_id", "instrument", "id"),),
    "instrument": (("venue_id", "venue", "id"),),
    "universe_snapshot": (("venue_id", "venue", "id"), ("instrument_id", "instrument", "id")),
    "order_event": (("order_id", "order", "id"),),
    "fill": (("order_id", "order", "id"),),
    "ledger_entry": (("account_id", "account", "id"), ("ref_fill_id", "fill", "id")),
    "backtest_run": (("strategy_id", "strategy", "id"), ("dataset_version_id", "dataset_version", "id")),
    "backtest_metrics": (("backtest_run_id", "backtest_run", "id"),),
    "backtest_trade": (("backtest_run_id", "backtest_run", "id"), ("instrument_id", "instrument", "id")),
}


def check_violations(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """One row per (row, rule) that is FALSE; a NULL outcome passes. Adds ``rule``."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(f"({text})"), F.lit(name)) for name, text in rules.items()]))
    return rows.withColumn("rule", F.explode(broken))


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``copies``."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def orphans(rows: DataFrame, column: str, referenced: DataFrame, referenced_column: str) -> DataFrame:
    """Rows whose reference points nowhere; NULL references are allowed."""
    targets = referenced.select(F.col(referenced_column).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(targets, column, "left_anti")


def audit(name: str, rows: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Count of offending rows or keys per rule of a table, zero counts left out."""
    parts = []
    if name in CHECKS:
        parts.append(check_violations(rows, CHECKS[name]).groupBy("rule").agg(F.count(F.lit(1)).alias("offences")))
    for key in UNIQUE_KEYS.get(name, ()):
        copies = duplicate_keys(rows, key).agg(F.count(F.lit(1)).alias("offences"))
        parts.append(copies.select(F.lit(f"unique({', '.join(key)})").alias("rule"), "offences"))
    for column, table, target in REFERENCES.get(name, ()):
        if tables and table in tables:
            lost = orphans(rows, column, tables[table], target).agg(F.count(F.lit(1)).alias("offences"))
            parts.append(lost.select(F.lit(f"{column} -> {table}.{target}").alias("rule"), "offences"))
    if not parts:
        raise ValueError(f"no rules for table {name!r}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("offences") > 0)


# What a row says about a rule: it breaks it, it holds a key, it refers to a key, it is a key referred to.
_BROKEN, _HOLDS, _REFERS, _IS = 0, 1, 2, 3


def _key(columns: Sequence[str]) -> Column:
    """Values as text that tells all keys apart; NULL if one of them is."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[part for text in texts[:-1] for part in (F.length(text).cast("string"), F.lit(":"), text)], texts[-1])


def _statements(name: str, tables: Mapping[str, DataFrame], numbers: dict[str, int]) -> list[Column]:
    """Everything the rules ask of a row of a table: (rule, kind, key), NULL where it says nothing. Rules are ``numbers``; new ones are added."""

    def said(rule: str, kind: int, key: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(numbers.setdefault(rule, len(numbers))).alias("rule"), F.lit(kind).alias("kind"), key.alias("key")))

    found = [said(f"{name}: {rule}", _BROKEN, F.lit(""), ~F.expr(f"({text})")) for rule, text in CHECKS.get(name, {}).items()]
    for columns in UNIQUE_KEYS.get(name, ()):
        found.append(said(f"{name}: unique({', '.join(columns)})", _HOLDS, _key(columns), _key(columns).isNotNull()))
    for child, references in REFERENCES.items():
        for column, target, target_column in references:
            rule = f"{child}: {column} -> {target}.{target_column}"
            if child == name and target in tables:
                found.append(said(rule, _REFERS, _key([column]), F.col(column).isNotNull()))
            if target == name and child in tables:
                found.append(said(rule, _IS, _key([target_column]), F.col(target_column).isNotNull()))
    return found


def audit_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, offences) of all rules of all ``tables`` at once, zero counts left out.

    Every row says what it has to say about all rules, checks, keys and references alike, so each table is read once and
    there is one shuffle, on (rule, key), for all of them; broken checks combine before it. Offences are rows for checks and
    references, repeated keys for unique rules. As in SQL a key with a NULL in it never repeats and a NULL reference is
    allowed. References into tables that are not given are left out.
    """
    parts, numbers = [], {}
    for name, rows in tables.items():
        said = _statements(name, tables, numbers)
        if not said:
            raise ValueError(f"no rules for table {name!r}")
        parts.append(rows.select(F.explode(F.array(*said)).alias("s")).where("s IS NOT NULL").select("s.*"))
    # The rows of a rule and key that are no keys referred to are all of one kind.
    counted = reduce(DataFrame.unionByName, parts).groupBy("rule", "key").agg(F.count_if(F.col("kind") != _IS).alias("n"), F.count_if(F.col("kind") == _IS).alias("known"), F.max("kind").alias("kind"))
    offences = F.when(F.col("kind") == _HOLDS, (F.col("n") > 1).cast("long")).otherwise(F.when(F.col("known") == 0, F.col("n")).otherwise(0))
    found = counted.groupBy("rule").agg(F.sum(offences).alias("offences")).where(F.col("offences") > 0)
    return found.select(F.element_at(F.array(*map(F.lit, numbers)), F.col("rule") + 1).alias("rule"), "offences")
