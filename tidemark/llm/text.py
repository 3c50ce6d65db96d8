"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare, scratch

# Rows that go to a Python worker at once, where the session does not say. Texts may be long.
BATCH_ROWS = 500
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

# The six ASCII characters that end a word (blank and 09 to 0D).
BLANKS = b" \t\n\x0b\x0c\r"

# Bytes of one text looked at in one go.
PIECE = 1 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session with UTC days and batches small enough for long texts."""
    prepare(spark)
    if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and what is read twice is made once."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def word_blocks(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text, block by block; a block ends between words, so that a long text is never held as words."""
    start, end = 0, len(data)
    while start < end:
        stop = min(end, start + size)
        if stop < end:
            ends = [p for p in (data.find(c, stop) for c in (BLANKS[i : i + 1] for i in range(len(BLANKS)))) if p >= 0]
            stop = min(ends, default=end)
        yield data[start:stop].split()
        start = stop
