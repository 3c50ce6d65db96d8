"""Benchmark decontamination by multi-pattern search over words (Wu and Manber)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import free_name, stored

WINDOW = 10
# Windows in one search table; a larger benchmark is searched table by table, a pass each.
TABLE_WINDOWS = 200_000

# A word is a run of 0-9, a-z (A-Z are lowered) and of everything beyond ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text; NULL has none."""
    return text.encode().translate(_FOLD).split() if text else []


class Search:
    """All windows of one length. Texts are sequences of words; a block is the last two words under the window.

    ``shift``: how far the window can move for a block; a block that occurs in no pattern lets it pass whole.
    ``buckets``: by the block that ends them, the patterns to compare with the text word for word.
    """

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[str, ...]]):
        self.length = length
        self.block = min(2, length)
        self.miss = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], tuple[str, ...]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.miss), length - end)
            self.buckets[pattern[length - self.block :]].append((pattern, items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(first word, items) of every place where a pattern occurs."""
        n, at, block = self.length, self.length, self.block
        shift, miss = self.shift.get, self.miss
        while at <= len(words):
            key = tuple(words[at - block : at])
            step = shift(key, miss)
            if step:
                at += step
                continue
            for pattern, items in self.buckets[key]:
                if tuple(words[at - n : at]) == pattern:
                    yield at - n, items
            at += 1


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All runs of ``window`` words; the whole, if there are fewer but some."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


Table = list[tuple[str | None, bytes]]


def search_tables(benchmark: DataFrame, item_id: str, text: str, window: int, table_windows: int = TABLE_WINDOWS) -> Iterator[Table]:
    """The items as (id as text, words joined by blanks), in lists of at most ``table_windows`` windows or one item.

    The benchmark comes in partition by partition and list by list; only the list being filled is held.
    """
    table: Table = []
    filled = 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        size = len(windows_of(words, window))
        if size and filled and filled + size > table_windows:
            yield table
            table, filled = [], 0
        if size:
            table.append((row["item"], b" ".join(words)))
            filled += size
    yield table


def _searches(table: list[tuple[str | None, bytes]], window: int) -> list[Search]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, joined in table:
        for w in windows_of(joined.split(b" "), window):
            by_length[len(w)][w] |= {item} if item is not None else set()
    return [Search(n, {w: tuple(sorted(i)) for w, i in found.items()}) for n, found in sorted(by_length.items())]


_FOUND = "struct<n_words: bigint, spans: array<bigint>, items: array<string>>"


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping and touching spans joined: start, end, start, end, ..."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def _found(table: Table, window: int):
    """A column function: the words of a text, the spans of words that are hit, the items that occur.

    It adds to what searches with other tables have found in the text before.
    """
    made: list[Search] = []

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.extend(_searches(table, window))
        rows = []
        for text, old_spans, old_items in zip(texts, before["spans"], before["items"], strict=True):
            words, items = words_of(text), set(old_items)
            spans = list(zip(old_spans[::2], old_spans[1::2], strict=True))
            for search in made:
                for start, ids in search.occurrences(words):
                    spans.append((start, start + search.length))
                    items.update(ids)
            rows.append((len(words), _merged(spans), sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return found


def find_passages(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    out: str = "found",
    table_windows: int = TABLE_WINDOWS,
) -> DataFrame:
    """The rows with a struct (n_words, spans, items): benchmark windows that occur in the text.

    spans holds first word and end of each merged stretch of hit words, in turn; items the ids, as text, of items
    with a window in the text, sorted. NULL and wordless texts have no words and no hits; so have items, which
    then match nothing. An item of fewer words than a window is one window, also of a single word. Items with a
    NULL id hit words but have no id to report. Repeated items count once. An empty benchmark hits nothing.
    ``out`` replaces a column of that name; other columns are carried along untouched.

    A search table that goes along with the tasks holds at most ``table_windows`` windows (or one item); a larger
    benchmark takes one pass over the texts for each such table, whose findings are stored in between.
    """
    df = df.withColumn(out, F.expr("named_struct('n_words', 0L, 'spans', cast(array() as array<bigint>), 'items', cast(array() as array<string>))"))
    for i, table in enumerate(search_tables(benchmark, item_id, item_text, window, table_windows)):
        df = stored(df, "searched") if i else df
        df = df.withColumn(out, _found(table, window)(F.col(text), F.col(out)))
    return df


def n_hit(found: Column) -> Column:
    """Hit words: the ends of the spans less their starts."""
    spans = found["spans"]
    return F.aggregate(F.transform(spans, lambda p, i: F.when(i % 2 == 0, -p).otherwise(p)), F.lit(0).cast("long"), lambda a, p: a + p)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows without any benchmark window in their text; all columns as they were. Same cases as above."""
    found = free_name(df, "found")
    return find_passages(df, benchmark, text, item_id, item_text, window, found).where(F.size(F.col(f"{found}.spans")) == 0).drop(found)
