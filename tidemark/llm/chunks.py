"""Substring dedup by content-defined chunks: a gear hash cuts, digests tell chunks that repeat."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import free_name

# A cut wherever the top bits of the gear hash of the last 16 bytes are zero, after LEAST bytes: every 31 bytes or so. With
# longer chunks (5 bits) two of a hundred passages of 51 words held no two chunks in a row that came to MIN_BYTES.
CUT_BITS = 4
LEAST, MOST = 16, 256
# A repeated stretch shorter than this is left alone.
MIN_BYTES = 120
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([i]), 2024) & 0xFFFF for i in range(256)], np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: each step shifts the hash by a bit and adds the byte's gear value, modulo 2 ** 16.

    A value so depends on the last 16 bytes alone; the sums over 2, 4, 8 and 16 bytes follow from each other.
    """
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint16(step)
        h = longer
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, between characters, at least LEAST and at most MOST bytes apart (the last may be shorter)."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate(((raw[1:] & 0xC0) != 0x80, [True])) if len(raw) else np.zeros(0, bool)
    wanted = np.flatnonzero((gear_hashes(raw) >> np.uint16(16 - CUT_BITS) == 0) & starts) + 1
    ends, last = [], 0
    for at in [*wanted.tolist(), len(data)]:
        while at - last > MOST:
            stop = last + MOST
            while not starts[stop - 1]:
                stop -= 1
            ends.append(stop)
            last = stop
        if at - last >= LEAST or at == len(data) > last:
            ends.append(at)
            last = at
    return ends


def chunks(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, stop, digest) for every chunk of every whole text, in bytes of UTF-8; none for NULL or empty texts."""

    @F.pandas_udf("array<struct<start: int, stop: int, digest: bigint>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([_chunks(t) for t in texts], dtype=object)

    return df.select(F.col(id_column).alias("id"), F.inline(cut(F.col(text))))


def _chunks(text: str | None) -> list[dict]:
    data = (text or "").encode("utf-8", "surrogatepass")
    ends = cuts(data)
    return [
        {"start": a, "stop": b, "digest": int.from_bytes(xxhash.xxh64_digest(data[a:b]), "big", signed=True)} for a, b in zip([0, *ends], ends, strict=False)
    ]


def repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, start, stop, kept_id): stretches of ``min_bytes`` or more whose chunks all occur in an earlier text.

    The text with the smallest id keeps what it shares; in all others the chunks with that digest are repeats, and
    repeats side by side are one stretch, whose kept_id is the smallest that keeps one of its chunks. As cuts
    follow from the last 16 bytes, a passage is cut alike wherever it stands, but for a chunk or two at either end. Digests
    have 64 bits; single chunks that agree by chance make no stretch. Repetition within one text is no repeat, and so
    rows that repeat an id add nothing. Rows with a NULL id or text take no part. Digests are summed up per task before
    they are shuffled, and the rows of a digest that many texts share are spread by Spark when it joins.
    """
    parts = chunks(df.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()), id_column, text)
    shared = parts.groupBy(F.col("digest").alias("known")).agg(F.min("id").alias("kept_id"), F.max("id").alias("last_id")).where("kept_id < last_id")
    later = parts.join(shared.select("known", "kept_id"), F.col("digest") == F.col("known")).where("id > kept_id").select("id", "start", "stop", "kept_id")
    order = Window.partitionBy("id").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = later.withColumn("begins", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
    numbered = begins.withColumn("stretch", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = numbered.groupBy("id", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_id").alias("kept_id"))
    return found.where(F.col("stop") - F.col("start") >= min_bytes).select(F.col("id").alias(id_column), "start", "stop", "kept_id")


def without_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows, each text without its repeated stretches; all columns and all rows stay, also of texts that become empty."""
    of, at = free_name(df, "repeats_of"), free_name(df, "repeats_at")
    stretches = repeats(df, id_column, text, min_bytes).groupBy(F.col(id_column).alias(of))
    spans = stretches.agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(at))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([_cut_out(t, s) for t, s in zip(texts, lists, strict=True)], dtype=object)

    joined = df.join(spans, F.col(id_column) == F.col(of), "left")
    kept = F.when(F.col(at).isNull(), F.col(text)).otherwise(cut_out(F.col(text), F.col(at)))
    return joined.withColumn(text, kept).drop(of, at)


def _cut_out(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    data, parts, last = text.encode("utf-8", "surrogatepass"), [], 0
    for span in spans:
        parts.append(data[last : span["start"]])
        last = span["stop"]
    return b"".join([*parts, data[last:]]).decode("utf-8", "surrogatepass")
