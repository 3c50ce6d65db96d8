"""Session settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Scratch folders of sessions on one machine, by application: the setting itself cannot be changed once a session runs.
_LOCAL: dict[str, str] = {}
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Runtime settings that results depend on (UTC days, keyed state with timers).
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that change results; leave sizing to the cluster."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder the cluster shares through ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests, bench) gets a temporary folder of its own; on a
    cluster its executors would not share one, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
