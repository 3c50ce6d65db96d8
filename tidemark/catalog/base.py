"""Registering queries, reading the given tables, and the shapes both engines start from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import MONEY
from tidemark.session import prepare

# Rounding to six places for display. A shade over one half, so that exact ties, which the engines
# reach with different last bits, do not sit on the border.
_HALF = 0.5001

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(prepare(spark), sf_dir))

        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Entry(run, sql)
        return fn

    return register


def present(df: DataFrame) -> DataFrame:
    """Columns in types both engines agree on: times as epoch microseconds, numbers rounded."""

    def shown(field: T.StructField) -> Column:
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.DecimalType | T.DoubleType | T.FloatType):
            c = F.floor(c.cast("double") * F.lit(1e6) + F.lit(_HALF)) / F.lit(1e6)
        elif isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
            c = c.cast("long")
        elif isinstance(kind, T.MapType | T.ArrayType | T.StructType):
            c = F.to_json(c)
        return c.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def us(sql: str) -> str:
    return f"epoch_us({sql})"


def r6(sql: str) -> str:
    return f"(floor(CAST({sql} AS DOUBLE) * 1e6 + {_HALF}) / 1e6 + 0.0)"


# -- candles ------------------------------------------------------------------------------------

STEP = {"1h": 3600, "15m": 900}


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def candles(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    """Bars per event type; ``arrival`` is the id of the first event of the bar."""
    step = STEP[interval] * 1_000_000
    slot = F.timestamp_micros((F.floor(F.unix_micros("ts") / F.lit(step)) * step).cast("long"))
    dec = lambda c: c.cast(MONEY)
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("instrument_id"), slot.alias("open_time"))
        .agg(
            dec(F.min_by("value", "ts")).alias("open"),
            dec(F.max("value")).alias("high"),
            dec(F.min("value")).alias("low"),
            dec(F.max_by("value", "ts")).alias("close"),
            dec(F.sum(F.when(F.col("value") >= 80, _k()).otherwise(0))).alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
            F.min("event_id").alias("arrival"),
        )
        .select("instrument_id", F.lit(interval).alias("interval"), "open_time", "open", "high", "low", "close", "volume", "trade_count", "arrival")
    )


def candles_sql(interval: str = "1h") -> str:
    step = STEP[interval] * 1_000_000
    return f"""SELECT event_type AS instrument_id, make_timestamp((epoch_us(ts) // {step}) * {step}) AS open_time,
 CAST(min_by(value, ts) AS DECIMAL(18,8)) AS open, CAST(max(value) AS DECIMAL(18,8)) AS high,
 CAST(min(value) AS DECIMAL(18,8)) AS low, CAST(max_by(value, ts) AS DECIMAL(18,8)) AS close,
 CAST(sum(CASE WHEN value >= 80 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) ELSE 0 END) AS DECIMAL(18,8)) AS volume,
 count(*) AS trade_count, min(event_id) AS arrival
 FROM events GROUP BY 1, 2"""


def dirty(bars: DataFrame) -> DataFrame:
    """Bars with planted faults: swapped high and low, negative volume, shifted times."""
    a = F.col("arrival")
    return bars.withColumns(
        {
            "high": F.when(a % 97 == 0, F.col("low")).otherwise(F.col("high")),
            "low": F.when(a % 97 == 0, F.col("high")).otherwise(F.col("low")),
            "volume": F.when(a % 89 == 0, F.lit(-1).cast(MONEY)).otherwise(F.col("volume")),
            "open_time": F.when(a % 83 == 0, F.timestamp_micros(F.unix_micros("open_time") + 30_000_000)).otherwise(F.col("open_time")),
        }
    )


DIRTY_SQL = """SELECT instrument_id, CASE WHEN arrival % 83 = 0 THEN open_time + INTERVAL 30 SECOND ELSE open_time END AS open_time,
 open, CASE WHEN arrival % 97 = 0 THEN low ELSE high END AS high, CASE WHEN arrival % 97 = 0 THEN high ELSE low END AS low,
 close, CASE WHEN arrival % 89 = 0 THEN CAST(-1 AS DECIMAL(18,8)) ELSE volume END AS volume, trade_count, arrival FROM candles"""

WITH_CANDLES = f"WITH RECURSIVE candles AS ({candles_sql()})"
WITH_DIRTY = f"{WITH_CANDLES}, dirty AS ({DIRTY_SQL})"
WITH_M15 = f"WITH candles AS ({candles_sql('15m')})"

# -- fills --------------------------------------------------------------------------------------


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fill per event; the user is the run. Every 50th fill is delivered twice."""
    e = table(spark, sf_dir, "events")
    kind, k = F.col("event_type"), _k()
    buys = kind.isin("purchase", "signup") | ((kind == "view") & (F.col("user_id") % 2 == 0))
    once = e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("fill_id"),
        "ts",
        F.when(buys, "buy").otherwise("sell").alias("side"),
        (1 + k % 10).cast(MONEY).alias("qty"),
        (F.col("value") + 1).cast(MONEY).alias("price"),
        (F.col("value") % 2 < 1).alias("is_maker"),
        F.lit("USDT").alias("currency"),
    )
    return once.withColumn("fee", (F.col("qty") * F.col("price") * F.lit(0.001).cast("decimal(4,3)")).cast(MONEY))


def redelivered(unique: DataFrame) -> DataFrame:
    """The fills with every 50th delivered twice."""
    return unique.unionByName(unique.where(F.col("fill_id") % 50 == 0))


FILLS_SQL = """SELECT user_id AS run_id, event_id AS fill_id, ts,
 CASE WHEN event_type IN ('purchase','signup') OR (event_type = 'view' AND user_id % 2 = 0) THEN 'buy' ELSE 'sell' END AS side,
 CAST(1 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS DECIMAL(18,8)) AS qty,
 CAST(value + 1 AS DECIMAL(18,8)) AS price, value % 2 < 1 AS is_maker,
 CAST((1 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10) * (value + 1) * 0.001 AS DOUBLE) AS fee FROM events"""


# -- equity -------------------------------------------------------------------------------------


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equity curve per event type: 100000 plus the running sum of (value - 50)."""
    from tidemark.plans.ordered import EQUITY, Measure, tidy

    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"), "ts", F.col("event_id").alias("seq"), (F.col("value") - 50).cast(MONEY).alias("step")
    )
    summed = tidy(EQUITY.running(e, {"total": Measure("sum", F.col("step"))}))
    return summed.select("run_id", "ts", "seq", (F.lit(100_000) + F.col("total")).cast("double").alias("equity"))


EQUITY_SQL = """SELECT event_type AS run_id, ts, event_id AS seq,
 CAST(100000 + sum(CAST(value - 50 AS DECIMAL(18,8))) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) AS equity FROM events"""
