"""Version trees, one-pass audits and latency sketches."""

from datetime import timedelta

import pytest
from helpers import START, bars
from pyspark.sql import functions as F

from tidemark.operators import audit, versioning
from tidemark.session import scratch
from tidemark.sources import landing


def _bars(spark):
    times = [START + timedelta(hours=6 * i) for i in range(40)]
    return bars(spark, range(1, 41), "a", "1h", times=times).unionByName(bars(spark, range(1, 41), "b", "1h", times=times))


def test_equal_rows_give_equal_trees_in_any_layout(spark):
    rows = _bars(spark)
    one, two = versioning.version_tree(rows), versioning.version_tree(rows.repartition(7, "close").orderBy(F.desc("close")))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert versioning.version_diff(one, two).count() == 0
    levels = {r["level"]: r["count"] for r in one.groupBy("level").count().collect()}
    assert levels == {"whole": 1, "series": 2, "day": 20}
    assert versioning.version_tree(rows.where("false")).count() == 0


@pytest.mark.parametrize(
    "edit, expected",
    [
        (lambda r: r.withColumn("close", F.when((F.col("arrival") == 5) & (F.col("instrument_id") == "a"), 0).otherwise(F.col("close")).cast("decimal(18,8)")), {("a", 1, "changed", 4, 4)}),
        (lambda r: r.where("NOT (arrival = 8 AND instrument_id = 'b')"), {("b", 2, "changed", 4, 3)}),
        (lambda r: r.where("NOT (arrival DIV 4 = 3 AND instrument_id = 'b')"), {("b", 3, "removed", 4, 0)}),
        (lambda r: r.unionByName(r.where("arrival = 0 AND instrument_id = 'a'")), {("a", 0, "changed", 4, 5)}),
        (lambda r: r.unionByName(r.where("arrival < 2 AND instrument_id = 'a'").withColumn("instrument_id", F.lit("c"))), {("c", 0, "added", 0, 2)}),
    ],
)
def test_planted_changes_are_found_where_they_are(spark, edit, expected):
    before, after = _bars(spark), edit(_bars(spark))
    trees = []
    for rows in (before, after):
        trees.append(scratch(spark, "tree"))
        versioning.store_tree(versioning.version_tree(rows), trees[-1])
    old, new = (spark.read.parquet(t) for t in trees)
    diff = versioning.version_diff(old, new)
    assert {(r["instrument_id"], (r["day"] - START.date()).days, r["change"], r["rows_before"], r["rows_after"]) for r in diff.collect()} == expected
    rows = versioning.changed_rows(before, after, diff)
    gone, come = before.select(rows.columns[1:]).exceptAll(after.select(rows.columns[1:])), after.select(rows.columns[1:]).exceptAll(before.select(rows.columns[1:]))
    assert rows.where("change = 'removed'").count() == gone.count() and rows.where("change = 'added'").count() == come.count()
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


def test_all_rules_at_once_equal_rules_one_by_one(spark):
    order = spark.createDataFrame([(1, 1, "a", 5, 5), (2, 1, "a", 5, 6), (3, 2, "a", 5, -1), (4, None, "a", None, 1), (5, None, "a", 1, 1)], "id long, venue_id long, client_order_id string, qty int, filled_qty int")
    event = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (9, 1), (None, 1), (2, 2)], "order_id long, seq int")
    fill = spark.createDataFrame([(1, 1, "x", 1, 1.0, 2.0), (2, 1, "x", 7, 0.0, 2.0), (3, 1, "y", 8, 1.0, -2.0)], "id long, venue_id long, venue_fill_id string, order_id long, qty double, price double")
    tables = {"order": order, "order_event": event, "fill": fill}
    found = {r["rule"]: r["offences"] for r in audit.audit_all(tables).collect()}
    assert found == {
        "order: ck_order_filled_qty_le_qty": 1, "order: ck_order_filled_qty_nonneg": 1, "order: unique(venue_id, client_order_id)": 1, "order_event: unique(order_id, seq)": 1,
        "order_event: order_id -> order.id": 1, "fill: order_id -> order.id": 2, "fill: ck_fill_qty_positive": 1, "fill: ck_fill_price_positive": 1, "fill: unique(venue_id, venue_fill_id)": 1,
    }
    for name in tables:
        mine = {r["rule"]: r["offences"] for r in audit.audit(name, tables[name].na.drop(subset=["venue_id"] if name == "order" else []), tables).collect()}
        assert mine == {rule.removeprefix(f"{name}: "): n for rule, n in found.items() if rule.startswith(f"{name}: ")}
    scans = audit.audit_all({k: t.withColumn("_s", F.lit(k)) for k, t in tables.items()})._jdf.queryExecution().executedPlan().toString()
    assert scans.count("Scan") == len(tables)
    assert audit.audit_all({"venue": spark.createDataFrame([(1, "a")], "id long, name string")}).count() == 0
    with pytest.raises(ValueError, match="no rules"):
        audit.audit_all({"nothing": order})


def test_merged_sketches_are_as_good_as_one(spark):
    rows = spark.range(60_000).selectExpr(
        "concat('s', id % 2) AS symbol", "timestamp_micros(1767225600000000 + id * 20000000) AS exchange_ts", "timestamp_micros(1767225600000000 + id * 20000000 + ((id * 7919) % 5000) * 1000) AS local_recv_ts"
    ).unionByName(spark.sql("SELECT 's0' AS symbol, timestamp'2026-01-01' AS exchange_ts, CAST(NULL AS timestamp) AS local_recv_ts"))
    days = landing.latency_sketches(rows)
    assert days.count() > 20
    exact = {r["symbol"]: r for r in landing.venue_latency(rows.where("local_recv_ts IS NOT NULL")).collect()}
    for r in landing.merged_latency(days).collect():
        mine = exact[r["symbol"]]
        assert (r["bars"], r["max_ms"]) == (mine["bars"], mine["max_ms"]) and r["mean_ms"] == pytest.approx(mine["mean_ms"])
        assert abs(r["p50_ms"] - mine["p50_ms"]) < 60 and abs(r["p99_ms"] - mine["p99_ms"]) < 60


def test_audit_keys_are_told_apart_and_carry_no_names(spark):
    """Keys whose texts run together differ; what is shuffled is a rule's number and a plain key, with no JSON made per row."""
    rows = spark.createDataFrame([("1", "23"), ("12", "3"), ("1:2", "3"), ("1", "2:3"), (None, "3"), (None, "3"), ("a", "b"), ("a", "b")], "name string, code_hash string")
    found = audit.audit_all({"strategy": rows})
    assert [tuple(r) for r in found.collect()] == [("strategy: unique(name, code_hash)", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and "filter(array" not in plan
