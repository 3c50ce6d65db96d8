"""Row fingerprints and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = 8


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON: keys sorted, values as text, NULLs kept."""
    text = F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(text, {"ignoreNullFields": "false"}), 256)


def hash_words(digest: Column) -> list[Column]:
    """A SHA-256 hex digest as eight 32-bit numbers."""
    return [
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
        for i in range(_WORDS)
    ]


def content_words(digest: Column) -> Column:
    """Aggregate: word-wise sums of row digests, as text.

    Each row's digest covers its key and time, so row order carries no information of its own and
    a sum, which combines map-side and cannot skew, fixes the content with multiplicity.
    """
    return F.concat_ws(",", *[F.sum(w).cast("string") for w in hash_words(digest)])
