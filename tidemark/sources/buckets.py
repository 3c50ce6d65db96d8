"""Candle tables in buckets: bars are written over a stored table without shuffling what is stored.

A table is bucketed and sorted by its key, so a hot instrument is spread over all buckets. Incoming bars are brought to the
same buckets and merged with them; each result is a table of its own, so a reader sees the old version or the new one
and nothing in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch
from tidemark.sources.store import CANDLE_KEY


def _saved(rows: DataFrame, label: str, buckets: int, key: Sequence[str], path: str | None) -> str:
    """Write rows, which are in one partition per bucket, as a new table below ``path``; returns its name."""
    name = f"{label}_{uuid.uuid4().hex}"
    where = scratch(rows.sparkSession, name) if path is None else f"{path.rstrip('/')}/{name}"
    rows.write.bucketBy(buckets, *key).sortBy(*key).format("parquet").option("path", where).saveAsTable(name)
    return name


def create(rows: DataFrame, label: str = "candle", buckets: int = 64, key: Sequence[str] = CANDLE_KEY, path: str | None = None) -> str:
    """The rows as a bucketed table, one sorted file a bucket; returns its name. Keys must be unique.

    A bucket is read by one task, so their number grows with the table; keep it at ``spark.sql.shuffle.partitions`` or above.
    """
    return _saved(rows.repartition(buckets, *key), label, buckets, key, path)


def merged(table: DataFrame, incoming: DataFrame, key: Sequence[str] = CANDLE_KEY, arrival: str = "arrival") -> DataFrame:
    """A bucketed table with ``incoming`` written over it, the last arrival of a key winning.

    Only the incoming rows are shuffled and sorted; repeats of a key combine before that.
    """
    columns, key = table.columns, list(key)
    rest = [c for c in columns if c not in key]
    newest = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), arrival).alias("_w"))
    both = table.join(newest, key, "full")
    value = lambda c: F.when(F.col("_w").isNotNull(), F.col(f"_w.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[c if c in key else value(c) for c in columns])


def upsert(name: str, incoming: DataFrame, label: str = "candle", buckets: int = 64, key: Sequence[str] = CANDLE_KEY, arrival: str = "arrival", path: str | None = None) -> str:
    """Write ``incoming`` over the bucketed table ``name`` as a new table in the same buckets; returns the new name."""
    return _saved(merged(incoming.sparkSession.table(name), incoming, key, arrival), label, buckets, key, path)


def drop(spark, name: str) -> None:
    """Forget a version nobody reads any more; its files go with the folder they are in."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
