"""The append-only record of backtest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.ordered import POSITION, Series, tidy

RUN_COLUMNS = ("run_id", "strategy_id", "code_hash", "params", "dataset_version_id", "seed", "git_sha", "started_at", "finished_at", "operator")
_BY_STRATEGY = Series(("strategy_id",), ("started_at", "run_id"), width=365 * 86_400)


def trial_counts(runs: DataFrame, series: Series = _BY_STRATEGY) -> DataFrame:
    """Add ``trial_count``: runs of the same strategy started before this one."""
    return tidy(series.index(runs).withColumn("trial_count", F.col(POSITION) - 1))


def metrics_rows(sheet: DataFrame, runs: DataFrame) -> DataFrame:
    """The metrics child row of every run; figures without a source stay NULL."""
    nothing = F.lit(None).cast("double")
    counted = trial_counts(runs).select("run_id", F.col("trial_count").alias("trial_count_at_time_of_run"))
    return sheet.join(counted, "run_id").select(
        F.col("run_id").alias("backtest_run_id"), "total_return", "cagr", nothing.alias("volatility"), "max_drawdown",
        "sharpe", "sortino", "calmar", nothing.alias("deflated_sharpe"), nothing.alias("probabilistic_sharpe"),
        "win_rate", "profit_factor", F.col("expectancy").alias("avg_trade_pnl"), nothing.alias("turnover"),
        "fees_pct_of_gross", "trial_count_at_time_of_run",
    )


def log_runs(runs: DataFrame, known: DataFrame, sheet: DataFrame, path: str) -> None:
    """Add run rows and their metrics below ``path``, both under one batch id.

    ``known`` are the runs already logged; they count as earlier trials but are not written again. The batch id follows
    from the runs it holds, and a batch replaces what an attempt at it that failed half-way has left. The run rows
    are written last: a batch counts once they are there (``logged_metrics``).
    """
    fresh = runs.join(known.select("run_id"), "run_id", "left_anti").select(*RUN_COLUMNS)
    everything = known.select(*RUN_COLUMNS).unionByName(fresh)
    count, mark = fresh.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("run_id"))).first()
    if not count:
        return
    batch = f"{count}-{mark & (2**64 - 1):016x}"
    for rows, table in ((metrics_rows(sheet.join(fresh.select("run_id"), "run_id", "left_semi"), everything), "backtest_metrics"), (fresh, "backtest_run")):
        written = rows.withColumn("log_batch", F.lit(batch))
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_batch").parquet(f"{path}/{table}")


def logged_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of batches whose run rows are there."""
    done = spark.read.parquet(f"{path}/backtest_run").select("log_batch").distinct()
    return spark.read.parquet(f"{path}/backtest_metrics").join(done, "log_batch", "left_semi").drop("log_batch")
