"""Order state from append-only order events, with every illegal history reported."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import POSITION, Series

# Which status may follow which.
LEGAL_NEXT = {
    "pending_new": ("sent",),
    "sent": ("acked", "rejected", "unknown"),
    "acked": ("partially_filled", "filled", "pending_cancel", "expired"),
    "partially_filled": ("partially_filled", "filled", "pending_cancel", "expired"),
    "pending_cancel": ("canceled", "filled", "partially_filled"),
}
# The status an event leads to.
STATUS_OF_EVENT = {
    "created": "pending_new",
    "sent": "sent",
    "acked": "acked",
    "rejected": "rejected",
    "unknown": "unknown",
    "partially_filled": "partially_filled",
    "filled": "filled",
    "cancel_requested": "pending_cancel",
    "canceled": "canceled",
    "expired": "expired",
}
TERMINAL = ("filled", "canceled", "rejected", "expired")

EVENTS = Series(("order_id",), ("seq", "ts", "event_id"), width=1 << 20, segment_rows=None)


def status_of(event_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_OF_EVENT.items())]), event_type)


def is_legal(before: Column, after: Column) -> Column:
    pairs = [f"{a}>{b}" for a, targets in LEGAL_NEXT.items() for b in targets]
    return F.coalesce(F.concat(before, F.lit(">"), after).isin(*pairs), F.lit(False))


def checked_events(events: DataFrame, series: Series = EVENTS) -> DataFrame:
    """Add ``status`` (after the event) and ``problem`` (NULL when the step is legal)."""
    seen = series.scan(events, previous=["event_type"], index=POSITION)
    first = F.col(POSITION) == 1
    status, before = status_of(F.col("event_type")), status_of(F.col("prev.event_type"))
    problem = (
        F.when(first & (F.col("event_type") != "created"), F.concat(F.lit("first event is "), F.col("event_type")))
        .when(F.col("seq") != F.col(POSITION), F.concat(F.lit("expected seq "), F.col(POSITION).cast("string"), F.lit(", got "), F.col("seq").cast("string")))
        .when(~first & ((F.col("event_type") == "created") | status.isNull()), F.concat(F.lit("illegal event "), F.col("event_type")))
        .when(~first & ~is_legal(before, status), F.concat(F.lit("illegal transition "), before, F.lit(" to "), status))
    )
    return seen.withColumns({"status": status, "problem": problem})


def order_states(events: DataFrame, series: Series = EVENTS) -> DataFrame:
    """One row per order: its status, or the first reason its history cannot be replayed."""
    broken = F.col("problem").isNotNull()
    return (
        checked_events(events, series)
        .groupBy(*series.keys)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.min_by("problem", F.when(broken, F.col(POSITION))).alias("problem"),
            F.min(F.when(broken, F.col(POSITION))).alias("problem_at"),
            F.max_by("status", POSITION).alias("_status"),
            F.max("ts").alias("updated_at"),
        )
        .withColumn("status", F.when(F.col("problem").isNull(), F.col("_status")))
        .withColumn("is_terminal", F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)))
        .drop("_status")
    )
