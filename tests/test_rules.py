"""Rules with state against a loop over bars, on one run that holds most of the bars."""

from datetime import timedelta

import numpy as np
import pytest
from helpers import START
from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.plans import jobs


def plain(bars, high, low, floor):
    """{(run, minute): (signal, entry, cause)} of a run's (minute, open, close) bars."""
    out = {}
    for run, line in bars.items():
        state, entry = "flat", None
        for minute, opened, close in line:
            if state == "ordered":
                state, entry = "held", opened
            signal = cause = None
            held = entry
            if state == "flat" and close > high:
                state, signal = "ordered", "buy"
            elif state == "held" and (close < low or floor is not None and close <= entry * floor):
                signal, cause = "sell", "rule" if close < low else "stop"
                state, entry = "flat", None
            out[run, minute] = (signal, held, cause)
    return out


def walks(seed, sizes):
    draw = np.random.default_rng(seed)
    return {
        run: [(int(m), round(50 + 20 * float(np.sin(k / 9)) + float(draw.normal()) * 8, 2), round(50 + 20 * float(np.sin(k / 9)) + float(draw.normal()) * 8, 2)) for k, m in enumerate(np.flatnonzero(draw.random(n * 2) < 0.5))]
        for run, n in sizes.items()
    }


def table(spark, bars):
    rows = [(r, "1m", START + timedelta(minutes=m), o, c) for r, line in bars.items() for m, o, c in line]
    return spark.createDataFrame(rows, "run_id string, interval string, open_time timestamp, open double, close double").withColumns({"entry": F.lit("x"), "other": F.col("close") * 2})


def shown(df):
    rows = df.collect()
    out = {(r["run_id"], int((r["open_time"] - START).total_seconds() // 60)): (r["signal"], r["entry"], r["cause"]) for r in rows}
    assert len(out) == len(rows) and all(r["other"] == r["close"] * 2 for r in rows)
    return out


@pytest.mark.parametrize("floor, width", [(0.9, 4), (0.9, 64), (0.97, 1), (None, 16), (0.2, 32)])
def test_any_cut_equals_a_loop(spark, floor, width):
    bars = walks(7, {"hot": 900, "b": 60, "c": 1, "d": 150})
    c = F.col("close")
    found = rules.with_positions(table(spark, bars), c > 60, c < 35, jobs.RUN_BARS.with_(width=width), floor)
    want = plain(bars, 60, 35, floor)
    assert shown(found) == want
    causes = {v[2] for v in want.values()}
    assert ("rule" in causes or floor == 0.97) and ("stop" in causes or floor in (None, 0.2))


def test_conditions_that_are_null_and_empty_runs(spark):
    bars = walks(1, {"a": 30})
    never = rules.with_positions(table(spark, bars), F.lit(None), F.lit(True), jobs.RUN_BARS, 0.9)
    assert all(v == (None, None, None) for v in shown(never).values())
    assert rules.with_positions(table(spark, bars).where("false"), F.lit(True), F.lit(True), jobs.RUN_BARS, 0.9).count() == 0
    always = shown(rules.with_positions(table(spark, bars), F.lit(True), F.lit(True), jobs.RUN_BARS.with_(width=2), None))
    assert [v[0] for _, v in sorted(always.items())] == ["buy", "sell"] * (len(always) // 2) + ["buy"] * (len(always) % 2)


def test_backtest_with_a_stop(spark):
    bars = walks(3, {"hot": 300, "b": 40})
    plain_bars = table(spark, bars).drop("entry", "other").withColumns({x: F.col(x).cast("decimal(18,8)") for x in ("open", "close")})
    c = F.col("close").cast("double")
    out = jobs.backtest(plain_bars, rules.band_rule(c > 60, c < 35, 0.9, warmup=10), 10)
    fills = out["fills"].orderBy("run_id", "ts").collect()
    assert fills
    for run in ("hot", "b"):
        assert [f["side"] for f in fills if f["run_id"] == run] == [("buy", "sell")[i % 2] for i in range(sum(f["run_id"] == run for f in fills))]
    entries = {(r["run_id"], r["open_time"]): r["entry"] for r in out["signals"].where("entry is not null").collect()}
    assert all(entries[f["run_id"], f["ts"]] == float(f["price"]) for f in fills if f["side"] == "buy")
