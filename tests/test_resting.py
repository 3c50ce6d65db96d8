"""Orders in a queue against a loop over bars and orders."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from helpers import MONEY, START
from pyspark.sql import functions as F

from tidemark.functions.money import FeeSchedule, FeeTier
from tidemark.operators import resting

FREE = FeeSchedule((FeeTier(Decimal(0), Decimal(0), Decimal(0)),))


def tables(spark, orders, bars):
    """Orders (id, book, minute, qty, filled) and bars (book, minute, volume)."""
    at = lambda m: START + timedelta(minutes=m)
    o = spark.createDataFrame([(i, k, "1m", at(m), "buy", Decimal(q), Decimal(f)) for i, k, m, q, f in orders], "order_id long, instrument_id string, interval string, placed_at timestamp, side string, qty decimal(18,8), filled_qty decimal(18,8)")
    o = o.withColumns({"lot_size": F.lit(Decimal("0.5")).cast(MONEY), "spread": F.lit(0.0), "volatility": F.lit(0.0), "is_maker": F.lit(False), "thirty_day_volume": F.lit(0)})
    b = spark.createDataFrame([(k, "1m", at(m), Decimal(100 + m), Decimal(v)) for k, m, v in bars], "instrument_id string, interval string, open_time timestamp, open decimal(18,8), volume decimal(18,8)")
    return o, b


def plain(orders, bars, share):
    """{(order, minute): (quantity, left)} by first come first served."""
    fills, left = {}, {i: Decimal(q) - Decimal(f) for i, _, _, q, f in orders}
    queue = sorted((o for o in orders if left[o[0]] > 0 and left[o[0]] % Decimal("0.5") == 0), key=lambda o: (o[2], o[0]))
    for k, m, v in sorted(bars, key=lambda b: b[1]):
        room = Decimal(v) * share
        for i, book, placed, _, _ in queue:
            take = min(room, left[i]) if book == k and placed < m else 0
            if take > 0:
                room -= take
                left[i] -= take
                fills[i, m] = (take, left[i])
    return fills


def found(df):
    rows = df.collect()
    out = {(r["order_id"], int((r["open_time"] - START).total_seconds() // 60)): (r["fill_qty"], r["remaining_qty"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_queue_against_a_loop(spark, seed):
    draw = random.Random(seed)
    hot = lambda: "hot" if draw.random() < 0.7 else draw.choice("ab")
    orders = [(i, hot(), draw.randint(0, 90), draw.choice(["1", "2.5", "30", "7"]), draw.choice(["0", "0", "1"])) for i in range(120)]
    bars = [(k, m, draw.choice(["0", "4", "10", "25"])) for k in ("hot", "a", "b") for m in range(0, 120) if draw.random() < 0.8]
    o, b = tables(spark, orders, bars)
    fills = resting.resting_fills(o, b, FREE, max_volume_fraction=Decimal("0.25"))
    want = plain(orders, bars, Decimal("0.25"))
    assert found(fills) == want
    for r in resting.resting_outcomes(o, fills).collect():
        mine = [q for (i, _), (q, _) in want.items() if i == r["order_id"]]
        assert r["fill_qty"] == sum(mine) and r["bars"] == len(mine)
        rest = r["qty"] - r["filled_qty"]
        assert r["outcome"] == ("invalid" if rest <= 0 else "filled" if sum(mine) == rest else "partially_filled" if mine else "open")


def test_waiting_order_and_its_limits(spark):
    orders = [(1, "a", 0, "10", "0"), (2, "a", 0, "3", "0"), (3, "a", 5, "1", "0"), (4, "a", 0, "1.25", "0"), (5, "b", 0, "1", "0"), (6, "a", 9, "1", "0")]
    bars = [("a", 0, "100"), ("a", 1, "4"), ("a", 2, "0"), ("a", 3, "8"), ("a", 5, "2"), ("a", 6, "100"), ("a", 9, "50")]
    o, b = tables(spark, orders, bars)
    fills = resting.resting_fills(o, b, FREE)
    # The bar of minute 0 is not for orders placed with it, idle capacity is lost, the bar of minute 5 not for the order placed then.
    assert found(fills) == {(1, 1): (4, 6), (1, 3): (6, 0), (2, 3): (2, 1), (2, 5): (1, 0), (3, 6): (1, 0)}
    outcome = {r["order_id"]: r["outcome"] for r in resting.resting_outcomes(o, fills).collect()}
    assert outcome == {1: "filled", 2: "filled", 3: "filled", 4: "precision", 5: "open", 6: "open"}


def test_no_orders_or_no_bars(spark):
    o, b = tables(spark, [(1, "a", 0, "1", "0")], [("a", 1, "5")])
    assert resting.resting_fills(o.where("false"), b, FREE).count() == 0
    assert resting.resting_fills(o, b.where("false"), FREE).count() == 0
