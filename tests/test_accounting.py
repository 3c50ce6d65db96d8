"""Positions against plain decimal bookkeeping; golden backtest; funding; execution; order states."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import MONEY, START, bars, fill_rows
from tidemark.functions.money import FeeSchedule, FeeTier
from tidemark.operators import accounting, execution, metrics, orders
from tidemark.plans import jobs
from tidemark.plans.ordered import FILLS

TINY = FILLS.with_(width=7 * 60, segment_rows=5)


def _book(fills):
    """Expected (qty, avg, realized, trade pnl) per fill."""
    qty = avg = realized = Decimal(0)
    out = []
    for side, q, p, fee in fills:
        q, p, fee = Decimal(str(q)), Decimal(str(p)), Decimal(str(fee))
        d = q if side == "buy" else -q
        trade = None
        if qty * d >= 0:
            avg = (abs(qty) * avg + q * p) / (abs(qty) + q)
            realized -= fee
        else:
            gain = min(abs(qty), q) * (p - avg) * (1 if qty > 0 else -1)
            trade = gain - fee
            realized += trade
            left = qty + d
            avg = Decimal(0) if left == 0 else (p if left * qty < 0 else avg)
        qty += d
        out.append((qty, avg, realized, trade))
    return out


def _replayed(df, series=FILLS):
    rows = accounting.replay(df, series).orderBy("fill_id").collect()
    return [(r.qty_after, r.avg_entry, r.realized_pnl, r.trade_pnl) for r in rows]


def _check(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0]
        assert g[1] == pytest.approx(float(w[1]), abs=1e-9) and g[2] == pytest.approx(float(w[2]), abs=1e-8)
        assert (g[3] is None) == (w[3] is None) and (w[3] is None or g[3] == pytest.approx(float(w[3]), abs=1e-8))


CASES = {
    "reduce": [("buy", 10, 100, 1), ("sell", 4, 120, 1)],
    "flip": [("buy", 5, 100, 0), ("sell", 8, 120, 0)],
    "short add": [("sell", 5, 100, 0), ("sell", 5, 110, 0)],
    "round trip": [("buy", 1, 50100, "50.1"), ("sell", 1, 52000, "52")],
}


def test_known_positions(spark):
    assert _replayed(fill_rows(spark, CASES["reduce"]))[-1] == (6, 100.0, 78.0, 79.0)
    assert _replayed(fill_rows(spark, CASES["flip"]))[-1] == (-3, 120.0, 100.0, 100.0)
    assert _replayed(fill_rows(spark, CASES["short add"]))[-1] == (-10, 105.0, 0.0, None)
    assert _replayed(fill_rows(spark, CASES["round trip"]))[-1][2] == pytest.approx(1797.90)


@pytest.mark.parametrize("series", [FILLS, TINY])
def test_random_fills_with_repeats(spark, series):
    rng = random.Random(5)
    fills = [(rng.choice(["buy", "sell"]), rng.randint(1, 9), round(rng.uniform(90, 110), 2), round(rng.uniform(0, 1), 3)) for _ in range(400)]
    df = fill_rows(spark, fills)
    repeated = df.unionByName(df.where("fill_id % 3 = 0")).unionByName(df.where("fill_id % 9 = 0"))
    _check(_replayed(repeated, series), _book(fills))


def test_fee_currency_must_not_mix(spark):
    df = fill_rows(spark, CASES["reduce"]).withColumn("currency", F.when(F.col("fill_id") == 0, "USDT").otherwise("BTC"))
    with pytest.raises(Exception, match="currency mismatch"):
        metrics.fee_totals(df).collect()


def test_fee_tiers():
    tier = lambda t: FeeTier(Decimal(t), Decimal("0.001"), Decimal("0.002"))
    for bad in ((), (tier(5),), (tier(0), tier(0)), (tier(0), tier(9), tier(3)), (tier(0), tier(-1))):
        with pytest.raises(ValueError):
            FeeSchedule(bad)


def test_trailing_volume_expires(spark):
    df = fill_rows(spark, [("buy", 1, 10, 0)] * 3).withColumn("ts", F.lit(START).cast("timestamp") + F.make_dt_interval(F.col("fill_id").cast("int") * 20))
    got = accounting.trailing_volume(df, ["run_id"]).orderBy("fill_id").collect()
    assert [float(r.thirty_day_volume) for r in got] == [0, 10, 10]


def test_golden_backtest(spark):
    closes = [96 + abs((i % 16) - 8) for i in range(60)]
    opens = [closes[0], *closes[:-1]]
    run = bars(spark, closes, opens=opens).withColumn("run_id", F.lit("golden"))
    out = jobs.backtest(run, jobs.toggle_rule(8), warmup=5)
    fills = out["fills"].orderBy("ts").collect()
    assert [(f.side, f.price, f.ts) for f in fills] == [
        ("sell" if i % 2 == 0 else "buy", 96 if i % 2 == 0 else 104, START + timedelta(minutes=9 + 8 * i)) for i in range(7)
    ]
    counters = out["counters"].head()
    assert (counters.bars_processed, counters.signal_opportunities, counters.signals_produced, counters.signals_discarded_during_warmup) == (60, 55, 7, 1)
    sheet = out["tearsheet"].head()
    # The expected figures of this run.
    expected = {
        "total_return": -0.00027696,
        "cagr": -0.9153578586514175,
        "max_drawdown": 0.00027696,
        "drawdown_duration_days": 0.04097222222222222,
        "sharpe": -14.733944536230954,
        "sortino": -10.848704065243777,
        "calmar": -3305.018264917019,
        "omega": 0.0,
        "win_rate": 0.0,
        "profit_factor": 0.0,
        "avg_win": None,
        "avg_loss": -8.104,
        "expectancy": -8.104,
        "time_in_market": 0.4406779661016949,
        "total_fees": 0.696,
        "slippage": None,
        "fees_pct_of_gross": 2.577777777777778,
        "currency": "USDT",
    }
    for name, value in expected.items():
        got = sheet[name]
        assert got == value if value is None or isinstance(value, str) else got == pytest.approx(value, rel=1e-9), (name, got)
    text = metrics.tearsheet_json(out["tearsheet"]).head().tearsheet
    assert '"avg_win":null' in text and '"currency":"USDT"' in text


def test_equity_at_or_below_zero(spark):
    curve = spark.createDataFrame([("r", START + timedelta(days=i), 0, e) for i, e in enumerate([10.0, 0.0, 5.0])], "run_id string, ts timestamp, seq int, equity double")
    with pytest.raises(Exception, match="no return can be told"):
        metrics.equity_metrics(curve).collect()
    lenient = metrics.equity_metrics(curve, strict=False).head()
    assert lenient.total_return == -0.5 and lenient.max_drawdown == 1.0
    flat = metrics.equity_metrics(curve.withColumn("equity", F.lit(1.0))).head()
    assert flat.sharpe is None and flat.omega is None and flat.calmar is None and flat.drawdown_duration_days == 2.0


def test_funding_catches_up_and_never_pays_twice(spark):
    h = lambda n: START + timedelta(hours=n)
    rows = [(1, h(7), 1), (2, h(8), 2), (3, h(8), 3), (4, h(25), 4), (5, h(26), 5)]
    seen = spark.createDataFrame([("p", i, t, START, Decimal(q), Decimal(100), 0.01) for i, t, q in rows],
                                 "position_id string, obs_id int, ts timestamp, opened_at timestamp, qty decimal(18,8), mark_price decimal(18,8), funding_rate double")
    got = accounting.funding_payments(seen).orderBy("accrued_at").collect()
    assert [(r.accrued_at, round(r.amount, 9)) for r in got] == [(h(8), -2.0), (h(16), -4.0), (h(24), -4.0)]


# -- execution ------------------------------------------------------------------------------------

SCHEDULE = FeeSchedule((FeeTier(Decimal(0), Decimal("0.0005"), Decimal("0.001")), FeeTier(Decimal(100), Decimal("0.0001"), Decimal("0.0002"))))
ORDER = dict(
    side="buy", qty="1", filled_qty="0", lot_size="0.1", min_notional="10", spread=0.0, volatility=0.0, available_balance="100000",
    balance_currency="USDT", quote_currency="USDT", is_maker=False, thirty_day_volume="0", volume="10",
)


def _evaluate(spark, strict=False, **changes):
    o = {**ORDER, **changes}
    amounts = ("qty", "filled_qty", "lot_size", "min_notional", "available_balance", "thirty_day_volume", "volume")
    df = spark.range(1).select(*[(F.lit(str(v)).cast(MONEY) if k in amounts else F.lit(v)).alias(k) for k, v in o.items()])
    bar = F.struct(F.lit(START).alias("open_time"), F.lit(50_000).cast(MONEY).alias("open"), F.col("volume").alias("volume"))
    return execution.evaluate_orders(df.withColumn("bar", bar), SCHEDULE, latency_seconds=3, strict=strict).head()


def test_clean_fill(spark):
    r = _evaluate(spark)
    assert (r.outcome, r.fill_qty, r.fill_price, r.fee, r.remaining_qty, r.fill_ts) == ("filled", 1, 50_000, 50, 0, START + timedelta(seconds=3))
    assert _evaluate(spark, is_maker=True, thirty_day_volume="100").fee == 5


@pytest.mark.parametrize(
    ("changes", "outcome"),
    [
        ({"qty": "1.05", "volume": "0"}, "precision"),
        ({"volume": "0", "min_notional": "999999"}, "no_fill"),
        ({"min_notional": "50000.01", "available_balance": "1"}, "min_notional"),
        ({"available_balance": "49999.99"}, "insufficient_margin"),
        ({"qty": "20"}, "insufficient_margin"),
        ({"qty": "20", "available_balance": "500000"}, "partially_filled"),
        ({"spread": -1.0}, "invalid"),
        ({"filled_qty": "1"}, "invalid"),
        ({"balance_currency": "EUR"}, "invalid"),
    ],
)
def test_outcomes(spark, changes, outcome):
    assert _evaluate(spark, **changes).outcome == outcome


def test_slippage_uses_what_is_left_not_what_fills(spark):
    r = _evaluate(spark, side="sell", qty="20", spread=2.0, volatility=5.0)
    assert r.fill_price == 50_000 - 1 - 10 and r.outcome == "insufficient_margin" or r.fill_price is None
    r = _evaluate(spark, side="sell", qty="20", spread=2.0, volatility=5.0, available_balance="9999999")
    assert (r.fill_price, r.fill_qty, r.remaining_qty) == (49_989, 10, 10)


def test_strict_raises(spark):
    with pytest.raises(Exception, match="cannot be evaluated"):
        _evaluate(spark, strict=True, spread=-1.0)


# -- order states ---------------------------------------------------------------------------------


def test_every_transition(spark):
    statuses = list(orders.STATUS_OF_EVENT.values())
    pairs = [(a, b) for a in statuses for b in statuses]
    df = spark.createDataFrame(pairs, "a string, b string")
    legal = {(r.a, r.b) for r in df.where(orders.is_legal(F.col("a"), F.col("b"))).collect()}
    assert legal == {(a, b) for a, targets in orders.LEGAL_NEXT.items() for b in targets}
    assert not any(a in orders.TERMINAL or a == "unknown" for a, _ in legal)


@pytest.mark.parametrize(
    ("history", "status", "problem"),
    [
        ([(1, "created"), (2, "sent"), (3, "acked"), (4, "partially_filled"), (5, "filled")], "filled", None),
        ([(1, "created"), (2, "sent"), (3, "acked"), (4, "cancel_requested"), (5, "canceled")], "canceled", None),
        ([(1, "sent")], None, "first event is sent"),
        ([(2, "created")], None, "expected seq 1, got 2"),
        ([(1, "created"), (3, "sent")], None, "expected seq 2, got 3"),
        ([(1, "created"), (2, "created")], None, "illegal event created"),
        ([(1, "created"), (2, "adopted")], None, "illegal event adopted"),
        ([(1, "created"), (2, "filled"), (3, "sent")], None, "illegal transition pending_new to filled"),
    ],
)
def test_histories(spark, history, status, problem):
    df = spark.createDataFrame([("o", s, START, s, e) for s, e in history], "order_id string, seq int, ts timestamp, event_id int, event_type string")
    r = orders.order_states(df).head()
    assert (r.status, r.problem) == (status, problem)


def _book_rows(spark, bars_of, fills_of):
    """Bars and fills of one run from {instrument: [(minute, price)]} and {instrument: [(minute, side, qty, price)]}."""
    at = lambda m: START + timedelta(minutes=m)
    rows = [("r", k, at(m), Decimal(str(c))) for k, line in bars_of.items() for m, c in line]
    made = [("r", k, i, at(m), side, Decimal(str(q)), Decimal(str(p)), Decimal(0), "USDT") for k, line in fills_of.items() for i, (m, side, q, p) in enumerate(line)]
    b = spark.createDataFrame(rows, "run_id string, instrument_id string, open_time timestamp, close decimal(18,8)")
    f = spark.createDataFrame(made, "run_id string, instrument_id string, fill_id long, ts timestamp, side string, qty decimal(18,8), price decimal(18,8), fee decimal(18,8), currency string")
    return b, f


def test_portfolio_keeps_the_last_close_over_a_gap(spark):
    b, f = _book_rows(
        spark,
        {"a": [(0, 100), (1, 110), (5, 130)], "b": [(1, 50), (2, 40), (3, 45), (5, 60)]},
        {"a": [(1, "buy", 2, 105), (5, "sell", 2, 120)], "b": [(2, "sell", 1, 48), (4, "buy", 1, 44)]},
    )
    positions = accounting.replay(f, accounting.BOOKS)
    curve = [r["equity"] for r in accounting.portfolio_curve(b, positions, 1000).orderBy("ts").collect()]
    # a: 0, +10 (2 x 110 - 105), kept while it has no bars, then +30 for good; b: 48 - close while short, then +4.
    assert curve == [1000, 1010, 1018, 1013, 1034]
    sheet = metrics.tearsheet(accounting.portfolio_curve(b, positions, 1000), f, positions=positions, book="instrument_id").first()
    assert sheet["time_in_market"] == pytest.approx(4 / 5) and sheet["win_rate"] == 1


def test_portfolio_of_many_books_equals_the_sum_of_their_curves(spark):
    names = [f"i{k}" for k in range(7)]
    bars_of = {k: [(m, 100 + (m * 7 + n * 3) % 11) for m in range(n, 400, n % 3 + 1)] for n, k in enumerate(names)}
    fills_of = {k: [(m, "buy" if (m // 5 + n) % 2 else "sell", 1 + m % 3, 100 + m % 9) for m in range(n, 400, 5)] for n, k in enumerate(names)}
    b, f = _book_rows(spark, bars_of, fills_of)
    positions = accounting.replay(f, accounting.BOOKS.with_(width=3600, segment_rows=20))
    found = {r["ts"]: r["equity"] for r in accounting.portfolio_curve(b, positions, 0).collect()}
    marks = {(r["instrument_id"], r["ts"]): r for r in positions.collect()}
    worth, state, close = {k: 0.0 for k in names}, {k: (0, 0, 0) for k in names}, {}
    prices = {(k, START + timedelta(minutes=m)): c for k, line in bars_of.items() for m, c in line}
    want = {}
    for at in sorted({t for _, t in [*marks, *prices]}):
        for k in names:
            if (k, at) in marks:
                r = marks[k, at]
                state[k] = (float(r["qty_after"]), r["avg_entry"], r["realized_pnl"])
            close[k] = prices.get((k, at), close.get(k))
            q, entry, pnl = state[k]
            worth[k] = pnl + (q * (close[k] - entry) if q and close[k] is not None else 0)
        if any((k, at) in prices for k in names):
            want[at] = sum(worth.values())
    assert found.keys() == want.keys() and all(found[t] == pytest.approx(want[t], abs=1e-6) for t in want)


def test_replay_is_the_same_however_it_is_cut(spark):
    """Long groups over several Arrow batches, many short ones in one batch, and flips on the borders."""
    fills = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('r', id % 700)) AS run_id", "id AS fill_id", "timestamp_seconds(1767225600 + id * 61) AS ts", "if((id * 7919) % 10 < 5, 'buy', 'sell') AS side",
        "CAST(1 + id % 5 AS decimal(18,8)) AS qty", "CAST(100 + (id * 31) % 17 AS decimal(18,8)) AS price", "CAST(0.01 AS decimal(18,8)) AS fee", "'USDT' AS currency",
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        shown = [
            {(r["run_id"], r["fill_id"]): (r["avg_entry"], r["realized_pnl"], r["trade_pnl"]) for r in accounting.replay(fills, FILLS.with_(**cut)).collect()}
            for cut in ({}, {"width": 3600}, {"width": 86_400, "segment_rows": 50})
        ]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(shown[0]) == 3000
    for other in shown[1:]:
        for key, (avg, pnl, trade) in shown[0].items():
            assert other[key][:2] == pytest.approx((avg, pnl), abs=1e-8)
            assert (trade is None and other[key][2] is None) or other[key][2] == pytest.approx(trade, abs=1e-8)
