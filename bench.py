"""Headline timings on one machine: prints one JSON line.

Inputs are tables derived from the given ones and written before the clock starts, as an operator
would find them: one single series of as many one-minute bars as `lineitem` has rows, hourly and
quarter-hour bars, fills and equity from `events`. Every timed query runs to a sink that takes all rows.
"""

from __future__ import annotations

import json
import os
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import base
from tidemark.catalog.series_queries import GAP_WINDOW, maintenance
from tidemark.catalog.store_queries import frame_texts
from tidemark.operators import accounting, asof, gaps, indicators, metrics, quality, versioning
from tidemark.plans import jobs
from tidemark.plans.ordered import Series, tidy
from tidemark.schemas import MONEY
from tidemark.session import local_session, scratch
from tidemark.sources import archive, landing, store
from tidemark.streaming.bars import to_table
from tidemark.streaming.indicators import stream_indicators


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a one-minute bar of one instrument, in shipping order."""
    items = base.table(spark, sf_dir, "lineitem").withColumn("id", F.monotonically_increasing_id())
    ordered = tidy(Series((), ("l_shipdate", "id"), width=86_400 * 30).index(items, "n"))
    price = F.col("l_extendedprice").cast(MONEY)
    return ordered.select(
        F.lit("L").alias("instrument_id"),
        F.lit("1m").alias("interval"),
        F.timestamp_micros(F.lit(1_577_836_800_000_000) + F.col("n") * 60_000_000).alias("open_time"),
        price.alias("open"),
        (price + 1).cast(MONEY).alias("high"),
        (price - 1).cast(MONEY).alias("low"),
        price.alias("close"),
        F.when(F.col("l_discount") > 0.07, 0).otherwise(F.col("l_quantity")).cast(MONEY).alias("volume"),
        F.col("n").alias("arrival"),
    )


def prepare(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {
        "series": long_series(spark, sf_dir).repartitionByRange(8, "open_time"),
        "hourly": base.candles(spark, sf_dir),
        "quarter": base.candles(spark, sf_dir, "15m"),
        "fills": base.redelivered(base.fills(spark, sf_dir)).repartition(8),
        "equity": base.equity(spark, sf_dir).repartition(8),
        "maintenance": maintenance(spark, sf_dir),
        "asks": requests(spark, sf_dir),
        "frames": frame_texts(spark, sf_dir).repartition(8),
    }
    return {name: jobs.staged(df, scratch(spark, f"bench-{name}")) for name, df in tables.items()}


def stored_series(bars: DataFrame) -> str:
    """The long series as a table that bars can be written over."""
    path = scratch(bars.sparkSession, "bench-store")
    store.upsert_in_place(bars, path)
    return path


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for the last bars of its type."""
    return base.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("instrument_id"), F.lit("1h").alias("interval"), "ts"
    )


def streamed(bars: DataFrame) -> DataFrame:
    """J3: all indicators of the long series as one stream, stored and read back."""
    spark = bars.sparkSession
    out = scratch(spark, "bench-stream")
    path = scratch(spark, "bench-source")
    rows = bars.select("instrument_id", "interval", "open_time", "high", "low", "close")
    rows.write.parquet(path)
    stream = stream_indicators(spark.readStream.schema(rows.schema).parquet(path))
    to_table(stream, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def archived(bars: DataFrame) -> DataFrame:
    """The older half of the series archived, verified and trimmed."""
    extra = {"venue": F.lit("v"), "symbol": F.lit("L"), "trade_count": F.lit(1).cast("long"), "is_closed": F.lit(True), "source": F.lit("bench")}
    _, trimmed = archive.archive(bars.withColumns(extra), "candle", scratch(bars.sparkSession, "bench-archive"), "b", datetime(2020, 8, 1), 30)
    return trimmed


def upserted(bars: DataFrame, path: str) -> DataFrame:
    """The last of a thousand parts of the series written over the stored table of it."""
    last = bars.agg(F.max("arrival")).first()[0]
    store.upsert_in_place(bars.where(F.col("arrival") > last * 0.999), path)
    return bars.sparkSession.read.parquet(path)


def timed_queries(t: dict[str, DataFrame], store_path: str) -> dict[str, object]:
    bars = t["series"]
    runs = bars.withColumn("run_id", F.lit("r"))
    return {
        "e1_sma": lambda: indicators.sma(bars, 20),
        "e2_ema": lambda: indicators.ema(bars, 12),
        "e3_rsi": lambda: indicators.rsi(bars),
        "e4_atr": lambda: indicators.atr(bars),
        "e5_bollinger": lambda: indicators.bollinger(bars),
        "e6_macd": lambda: indicators.macd(bars),
        "e7_rolling_volatility": lambda: indicators.rolling_volatility(bars, 20),
        "e1_e7_panel": lambda: indicators.panel(bars),
        "g1_all_violations": lambda: quality.violations(bars),
        "e12_gap_runs": lambda: gaps.classify(gaps.gaps(t["quarter"], *GAP_WINDOW()), t["maintenance"]),
        "c5_next_bar": lambda: asof.next_bars(bars),
        "c6_last_n_bars": lambda: asof.last_n_bars(t["asks"], t["hourly"], 3),
        "a5_archive": lambda: archived(bars),
        "a9_upsert": lambda: upserted(bars, store_path),
        "j3_stream_indicators": lambda: streamed(bars),
        "f1_event_order": lambda: asof.event_order(t["hourly"].unionByName(t["quarter"])),
        "i1_position_replay": lambda: accounting.replay(t["fills"]),
        "d8_d12_equity_metrics": lambda: metrics.equity_metrics(t["equity"]),
        "h2_content_hash": lambda: versioning.dataset_versions(bars),
        "a3_kline_frames": lambda: landing.parse_frames(t["frames"]),
        "k4_backtest": lambda: jobs.backtest(runs, jobs.toggle_rule(8), 5, starting_cash=1e9)["tearsheet"],
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    start = time.time()
    tables = prepare(spark, sf_dir)
    rows = tables["series"].count()
    store_path = stored_series(tables["series"])
    setup = time.time() - start
    seconds: dict[str, float] = {}
    for name, build in timed_queries(tables, store_path).items():
        best = float("inf")
        for _ in range(2):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - start)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "series_rows": rows,
                "setup_seconds": round(setup, 2),
                "backtest_bars_per_minute": round(rows / seconds["k4_backtest"] * 60),
            }
        )
    )


if __name__ == "__main__":
    main()
