"""Repeated, late, missing and empty inputs: nothing may vanish, nothing may be counted twice."""

import shutil
from datetime import timedelta
from decimal import Decimal

import pytest
from helpers import START, bars, column, fill_rows
from pyspark.sql import functions as F

from tidemark.operators import asof, indicators, metrics, registry, versioning
from tidemark.plans import jobs
from tidemark.session import scratch
from tidemark.sources import archive, store
from tidemark.sources.candles import load_version, registered_version


def _hot(spark, n=40):
    plain = bars(spark, range(1, n + 1), interval="1h", times=[START + timedelta(days=3 * i) for i in range(n)])
    return plain.withColumns({"venue": F.lit("v"), "symbol": F.lit("S"), "trade_count": F.lit(1).cast("long"), "is_closed": F.lit(True), "source": F.lit("x")})


def test_archive_batch_may_be_repeated(spark):
    hot, path, now = _hot(spark), scratch(spark, "archive"), START + timedelta(days=100)
    report, trimmed = archive.archive(hot, "candle", path, "b", now, retention_days=10)
    trimmed = jobs.staged(trimmed, scratch(spark, "hot"))
    assert report.where("checksum_ok").count() == report.count() > 1
    again, _ = archive.archive(hot, "candle", path, "b", now, retention_days=10)
    assert again.where("checksum_ok").count() == again.count()
    archive.archive(trimmed, "candle", path, "b", now, retention_days=10)
    archive.archive(trimmed, "candle", path, "c", now + timedelta(days=15), retention_days=10)
    kept = archive.read(spark, "candle", path)
    assert kept.count() == kept.select("open_time").distinct().count() == hot.where(F.col("open_time") < now + timedelta(days=5)).count()


def test_runs_without_fills_or_curve_stay_in_the_tearsheet(spark):
    equity = spark.createDataFrame(
        [(r, START + timedelta(days=d), d, e) for r, d, e in [("both", 0, 100.0), ("both", 1, 110.0), ("idle", 0, 100.0), ("idle", 1, 90.0), ("short", 0, 100.0)]],
        "run_id string, ts timestamp, seq long, equity double",
    )
    fills = fill_rows(spark, [("buy", 1, 100, 1), ("sell", 1, 120, 1)], "both").unionByName(fill_rows(spark, [("buy", 1, 100, 1)], "lost"))
    rows = {r["run_id"]: r for r in metrics.tearsheet(equity, fills).collect()}
    assert {k: r["problem"] for k, r in rows.items()} == {"both": None, "idle": "fills", "short": "equity", "lost": "equity"}
    assert rows["idle"]["total_return"] == pytest.approx(-0.1) and rows["idle"]["total_fees"] == 0 and rows["idle"]["win_rate"] is None
    assert rows["lost"]["total_return"] is None and float(rows["lost"]["total_fees"]) == 1
    with pytest.raises(Exception, match="lacks"):
        metrics.tearsheet(equity, fills, strict=True).collect()


def test_listed_series_without_bars_is_a_gap(spark):
    have = bars(spark, range(5), key="a")
    wanted = spark.createDataFrame([("a", "1m"), ("b", "1m")], "instrument_id string, interval string")
    none = spark.createDataFrame([], "window_start timestamp, window_end timestamp")
    known, _, ranges = jobs.gap_scan(have, START, START + timedelta(minutes=4), none, series_list=wanted)
    assert [(r["instrument_id"], r["missing_count"]) for r in known.collect()] == [("b", 5)]
    assert ranges.count() == 1


def plain_ema(prices, span):
    a, y, out = 2 / (span + 1), None, []
    for p in prices:
        if p is not None and p == p:
            y = p if y is None else y + a * (p - y)
        out.append(y)
    return out


def _seen(values):
    """NULL as a number no mean has, as None cannot be compared within a tolerance."""
    return [-1e6 if v is None else v for v in values]


@pytest.mark.parametrize("missing", [None, float("nan")])
@pytest.mark.parametrize("span", [1, 3, 12])
def test_exponential_means_over_missing_prices(spark, missing, span):
    prices = [missing, 100.0, missing, 101.0] + [100.0 + i % 17 for i in range(700)]
    for at in (50, 51, 52, 333):
        prices[at] = missing
    df = bars(spark, [1] * len(prices)).withColumn("p", F.element_at(F.array(*[F.lit(p).cast("double") for p in prices]), (F.col("arrival") + 1).cast("int")))
    assert _seen(column(indicators.ema(df, span, price="p"), "ema")) == pytest.approx(_seen(plain_ema(prices, span)), rel=1e-12)
    out = indicators.macd(df, 3, 5, 4, price="p")
    fast, slow = plain_ema(prices, 3), plain_ema(prices, 5)
    line = [f - s if f is not None else None for f, s in zip(fast, slow, strict=True)]
    assert _seen(column(out, "macd")) == pytest.approx(_seen(line), abs=1e-9)
    signal = plain_ema([x if p is not None and p == p else None for x, p in zip(line, prices, strict=True)], 4)
    assert _seen(column(out, "macd_signal")) == pytest.approx(_seen(signal), abs=1e-9)


def test_busy_requests_are_split(spark):
    """One instrument holds nine tenths of the requests; its bars and requests share segments of equal meaning."""
    have = bars(spark, range(300), key="a", interval="1h").unionByName(bars(spark, range(30), key="b", interval="1h"))
    have = have.withColumn("open_time", F.timestamp_micros(F.unix_micros("open_time").cast("long") + F.col("arrival") * (3_600_000_000 - 60_000_000)))
    asks = spark.range(1000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("instrument_id"), F.lit("1h").alias("interval"),
        F.timestamp_micros(F.lit(int(START.timestamp() * 1e6)) + F.col("id") * 1_000_000_007).alias("ts"),
    )
    found = asof.last_n_bars(asks, have, 3)
    bars_of = {}
    for r in have.collect():
        bars_of.setdefault(r["instrument_id"], []).append(r["open_time"])
    want = set()
    for r in asks.collect():
        closed = sorted(t for t in bars_of[r["instrument_id"]] if t + timedelta(hours=1) < r["ts"])
        want |= {(r["request_id"], t) for t in closed[-3:]}
    assert {(r["request_id"], r["open_time"]) for r in found.collect()} == want


def test_upsert_touches_only_partitions_it_must(spark, tmp_path):
    path = str(tmp_path / "candles")
    first = bars(spark, range(1, 5), times=[START + timedelta(days=i) for i in range(4)])
    store.upsert_in_place(first, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "candles").rglob("*.parquet")}
    change = bars(spark, [50, 51, 52], times=[START + timedelta(days=1)] * 2 + [START + timedelta(days=9)])
    store.upsert_in_place(change, path)
    rows = {r["open_time"]: r["close"] for r in spark.read.parquet(path).collect()}
    assert rows == {START + timedelta(days=i): Decimal(v) for i, v in ((0, 1), (1, 51), (2, 3), (3, 4), (9, 52))}
    untouched = [p for p in before if p.exists()]
    assert len(untouched) == 3


def test_absent_rows_are_chosen_the_same_way_every_time(spark):
    there = spark.createDataFrame([(1, "x", 0)], "id long, kind string, v long")
    new = spark.createDataFrame([(2, "b", 5), (2, "a", 9), (1, "x", 7), (3, None, None)], "id long, kind string, v long")
    assert sorted(tuple(r) for r in store.insert_if_absent(there, new, ["id"]).collect()) == [(2, "a", 9), (3, None, None)]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Session(), "x")


def test_half_written_log_batch_does_not_count_twice(spark, tmp_path):
    path = str(tmp_path / "registry")
    none = F.lit(None).cast("string")
    runs = spark.createDataFrame([("a", "s"), ("b", "s")], "run_id string, strategy_id string").withColumns(
        {c: none for c in ("code_hash", "params", "dataset_version_id", "git_sha", "operator")} | {"seed": F.lit(1), "started_at": F.lit(START), "finished_at": F.lit(START)}
    )
    sheet = runs.select("run_id", *[F.lit(1.0).alias(c) for c in metrics.TEARSHEET if c != "currency"], F.lit("USDT").alias("currency"))
    registry.log_runs(runs, runs.limit(0), sheet, path)
    shutil.rmtree(f"{path}/backtest_run")
    registry.log_runs(runs, runs.limit(0), sheet, path)
    registry.log_runs(runs, spark.read.parquet(f"{path}/backtest_run"), sheet, path)
    assert sorted(r["backtest_run_id"] for r in registry.logged_metrics(spark, path).collect()) == ["a", "b"]


def test_version_is_of_the_requested_days(spark):
    have = bars(spark, range(5), times=[START + timedelta(days=i) for i in range(5)])
    first, last = START.date(), (START + timedelta(days=2)).date()
    version = versioning.dataset_versions(have, requested=(first, last)).first()
    assert (version["row_count"], version["date_range_start"], version["date_range_end"]) == (3, first, last)
    wide = versioning.dataset_versions(have.limit(5).where("arrival < 3"), requested=(first, (START + timedelta(days=9)).date())).first()
    assert wide["content_hash"] != version["content_hash"]
    known = versioning.register(versioning.dataset_versions(have).select(F.col("content_hash").alias("dataset_version_id"), "content_hash", "symbol_set", "date_range_start", "date_range_end", F.lit(START).alias("created_at")).limit(0), versioning.dataset_versions(have, requested=(first, last)), START)
    loaded = load_version(have, spark.createDataFrame([("a", "A")], "id string, symbol string"), registered_version(known, version["content_hash"]), ["1m"])
    assert loaded.count() == 3
    with pytest.raises(ValueError, match="not registered"):
        registered_version(known, "x")
