"""Language identification as mixture inference over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import PIECE, free_name

# Hash buckets of three-letter n-grams, and languages a model may have: together they bound its size.
BUCKETS = 1 << 16
MAX_LANGUAGES = 400
# Added to every count.
SMOOTHING = 0.5
ROUNDS = 16
# A language joins the set if it raises the log likelihood by more than this times log(n-grams).
PENALTY = 3.0
# A language whose share of a text is below this is no candidate for its set.
LEAST_SHARE = 0.02
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as numbers; whatever stands between words is one blank, also at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    return np.where(letter, codes, np.uint32(32))[letter | np.concatenate(([True], letter[:-1]))]


def n_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a whole text's n-grams of three, taken in pieces; empty without a letter."""
    parts, text = [], text or ""
    for start in range(0, len(text), PIECE):
        c = _codes(text[start : start + PIECE])
        if len(c) > 2:
            mixed = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
            parts.append(np.unique((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16), return_counts=True))
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    whole = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), BUCKETS).astype(np.int64)
    return np.flatnonzero(whole).astype(np.uint32), whole[whole > 0]


def n_gram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows whose language is known; a task sums up before anything is shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for k, v in sums.items():
                yield pd.DataFrame({"lang": k, "bucket": np.flatnonzero(v), "n": v[v > 0]})
            sums.clear()

        for batch in batches:
            for k, t in zip(batch["lang"], batch["text"], strict=True):
                buckets, counts = n_grams(t)
                if len(buckets):
                    sums.setdefault(k, np.zeros(BUCKETS, np.int64))[buckets] += counts
            if len(sums) > 64:
                yield from flushed()
        yield from flushed()

    known = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return known.mapInPandas(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of n-gram buckets, one row per bucket and one column per language."""

    def __init__(self, languages: list[str], log_probability: np.ndarray):
        self.languages, self.log_probability = languages, log_probability


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with text and language. What reaches the driver is languages times BUCKETS numbers at most."""
    counts = n_gram_counts(df, text, lang).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    rows = counts.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((BUCKETS, len(rows)), SMOOTHING)
    for i, row in enumerate(rows):
        pairs = np.array(row["counts"], np.int64).reshape(-1, 2)
        table[pairs[:, 0], i] += pairs[:, 1]
    return Model([r["lang"] for r in rows], np.log(table / table.sum(axis=0)).astype(np.float32) if rows else table.astype(np.float32))


class _Batch:
    """N-grams of some documents, one after the other."""

    def __init__(self, buckets: list[np.ndarray], counts: list[np.ndarray], model: Model):
        sizes = np.array([len(b) for b in buckets])
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.count = np.concatenate(counts).astype(np.float64)
        log_p = model.log_probability[np.concatenate(buckets)].astype(np.float64)
        self.top = log_p.max(axis=1)
        self.p = np.exp(log_p - self.top[:, None])
        self.total = self.by_doc(self.count)

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)

    def part(self, docs: np.ndarray) -> _Batch:
        """Only these documents (a mask)."""
        other = object.__new__(_Batch)
        rows = docs[self.doc]
        sizes = np.bincount(self.doc, minlength=len(docs))[docs]
        other.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        other.doc = np.repeat(np.arange(len(sizes)), sizes)
        other.count, other.top, other.p, other.total = self.count[rows], self.top[rows], self.p[rows], self.total[docs]
        return other

    def em(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expectation-maximisation from these shares: (shares, log likelihoods). A share of 0 stays 0."""
        for _ in range(ROUNDS):
            joint = self.p * share[self.doc]
            share = self.by_doc(joint * (self.count / joint.sum(axis=1))[:, None]) / self.total[:, None]
        mixed = (self.p * share[self.doc]).sum(axis=1)
        return share, self.by_doc(self.count * (np.log(mixed) + self.top))


def mixtures(texts: list[str | None], model: Model) -> list[dict[str, float]]:
    """The language shares of each text, largest first; empty without a letter or without a model.

    First all languages are fitted. Then the sets of its one, two, ... largest shares are fitted each, and the set
    with the highest log likelihood less ``PENALTY`` * log(n-grams) for every language after the first is chosen.
    """
    found: list[dict[str, float]] = [{} for _ in texts]
    grams = [n_grams(t) for t in texts]
    which = [i for i, g in enumerate(grams) if len(g[0])]
    if not which or not model.languages:
        return found
    batch = _Batch([grams[i][0] for i in which], [grams[i][1] for i in which], model)
    k = len(model.languages)
    free, _ = batch.em(np.full((len(which), k), 1.0 / k))
    order = np.argsort(-free, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, score = np.zeros((len(which), k)), np.full(len(which), -np.inf)
    penalty = PENALTY * np.log(batch.total + 1)
    for n in range(1, k + 1):
        docs = np.take_along_axis(free, order[:, n - 1 : n], axis=1)[:, 0] >= LEAST_SHARE if n > 1 else np.ones(len(which), bool)
        if not docs.any():
            break
        start = np.where(rank[docs] < n, np.maximum(free[docs], 1e-9), 0.0)
        share, likelihood = batch.part(docs).em(start / start.sum(axis=1, keepdims=True))
        value = likelihood - (n - 1) * penalty[docs]
        better = value > score[docs]
        at = np.flatnonzero(docs)[better]
        best[at], score[at] = share[better], value[better]
    for row, i in enumerate(which):
        ranked = sorted(((float(best[row, j]), model.languages[j]) for j in np.flatnonzero(best[row] > 0)), key=lambda x: (-x[0], x[1]))
        found[i] = {name: min(1.0, s) for s, name in ranked}
    return found


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "languages") -> DataFrame:
    """The rows with an array of (lang, share), largest share first.

    NULL texts and texts without a letter have an empty array, and so has every text if the model knows no language. Whole
    texts count. Rows alike in text get the same; other columns play no part and are carried along; ``out`` replaces a column of that name.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.log_probability))

    @F.pandas_udf("array<struct<lang: string, share: double>>")
    def shares(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"lang": k, "share": v} for k, v in m.items()] for m in mixtures(list(texts), Model(*sent.value))])

    return df.withColumn(out, shares(F.col(text)))


def predicted(languages: Column) -> tuple[Column, Column]:
    """(language, its share): the largest share, or ``und`` and 0."""
    first = F.get(languages, F.lit(0))
    return F.coalesce(first["lang"], F.lit(UNKNOWN)), F.coalesce(first["share"], F.lit(0.0))


def held_out(id_column: Column) -> Column:
    """The fold nothing is learned from; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def known_language(df: DataFrame, model: Model, text: str = "text", share: float = 0.5) -> DataFrame:
    """The rows with a language that makes up ``share`` of the text or more; columns as they were."""
    out = free_name(df, "languages")
    name, part = predicted(F.col(out))
    return identify(df, model, text, out).where((name != UNKNOWN) & (part >= share)).drop(out)
