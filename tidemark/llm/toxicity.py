"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Documents are labelled, tokens are not. A word is taken to be toxic in a toxic document if toxic documents use it, next
to different neighbours, far more often than clean ones do; copies of one document count once, as their neighbours are
the same. A chain of two states is fitted to tokens so labelled, then the tokens of toxic documents are labelled
again by it and it is fitted once more, so that words that share beginnings or letters with toxic ones are found too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import PIECE, free_name, stored

# How many times a word's share among toxic documents must be that among clean ones. Of its contexts in the former so many
# standard deviations are taken off, so that a few chance occurrences mark no word.
LEAST_RATIO, CAUTION = 20.0, 1.64
# Words taken to be toxic at most, strongest first. They only label the tokens of the sample.
SEEDS = 20_000
# Labelled documents a fit looks at: of each class so many for the chain and so many for the score, all different, by
# digest order and none larger than so many bytes. All else that is learned counts all labelled documents.
CHAIN_SAMPLE, SCORE_SAMPLE, SAMPLE_BYTES = 800, 400, 32_768
# Hashed features, rounds of the two fits, weight of the penalty on squared weights.
FEATURES = 1 << 18
ROUNDS = (30, 15)
PENALTY = 0.1
# A chain is cut after so many tokens, so that the longest text takes bounded memory.
CHAIN = 1 << 16
# Different words whose weights a task remembers.
KNOWN_WORDS = 1 << 18
SPAN = 0.5

_TOKEN = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[\W_]")
TAGS = "struct<score:double,n_tokens:bigint,expected:double,spans:array<struct<start:bigint,stop:bigint>>>"


# -- features -----------------------------------------------------------------------------------------------


_BIAS = FEATURES - 1


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Hashes as slots of the weight table."""
    h = (h ^ np.uint32(salt)) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(16))) & np.uint32(FEATURES - 1)).astype(np.int64)


def word_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, the word each belongs to, slots of what a word lends the token after it and the one before it).

    Features of a word, without case: itself, its beginnings of three to eight letters and its groups of three
    letters (of a very long word the first 64 letters).
    """
    lower = [w.lower() for w in words]
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in lower], np.uint32)
    cut = [w[:64] for w in lower]
    sizes = np.array([len(w) for w in cut], np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in cut).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    begin = np.cumsum(np.append(0, sizes + 2))[:-1]
    grams = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x7FEB352D) + codes[2:] * np.uint32(0x846CA68B)
    inside = owner[:-2] == owner[2:]
    slots, owners = [_mixed(whole, 1), _mixed(grams[inside], 2)], [np.arange(len(words)), owner[:-2][inside]]
    h = np.zeros(len(words), np.uint32)
    for n in range(1, 9):
        there = np.flatnonzero(sizes >= n)
        h[there] = h[there] * np.uint32(0x01000193) + codes[begin[there] + n]
        if n > 2:
            slots.append(_mixed(h[there] + np.uint32(n), 3))
            owners.append(there)
    return np.concatenate(slots), np.concatenate(owners), np.stack((_mixed(whole, 4), _mixed(whole, 5)))


def tokens(text: str) -> Iterator[tuple[int, list[str]]]:
    """(offset, words) of a text, piece by piece; pieces end between words."""
    start = 0
    while start < len(text):
        cut = _BREAK.search(text, start + PIECE) if start + PIECE < len(text) else None
        stop = cut.start() if cut else len(text)
        yield start, _TOKEN.findall(text[start:stop])
        start = stop


# -- chains of two states -----------------------------------------------------------------------------------


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r_t = (a_t r + b_t) / (c_t r + d_t) with r the value before, for all t; the first must not depend on it.

    The maps compose like 2 x 2 matrices: stretches are composed side by side, chained, and run again from their starts.
    """
    n = len(a)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    grid = []
    for values, filler in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        full = np.full(rows * width, filler)
        full[:n] = values
        grid.append(np.ascontiguousarray(full.reshape(rows, width).T))
    p, q, s, t = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for A, B, C, D in zip(*grid, strict=True):
        p, q, s, t = A * p + B * s, A * q + B * t, C * p + D * s, C * q + D * t
        top = np.maximum(np.maximum(p, q), np.maximum(s, t))
        p, q, s, t = p / top, q / top, s / top, t / top
    r, starts = 0.0, np.empty(rows)
    for i, (A, B, C, D) in enumerate(zip(p.tolist(), q.tolist(), s.tolist(), t.tolist(), strict=True)):
        starts[i] = r
        r = (A * r + B) / (C * r + D)
    out, r = np.empty((width, rows)), starts
    for k, (A, B, C, D) in enumerate(zip(*grid, strict=True)):
        r = (A * r + B) / (C * r + D)
        out[k] = r
    return out.T.ravel()[:n]


def forward_backward(scores: np.ndarray, first: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of the toxic state, forward and backward odds) of many chains written one after the other.

    ``scores`` are log odds of the toxic state by themselves, ``first`` marks where a chain begins, ``turns[i, j]`` are
    the factors for going from state i to j.
    """
    odds = np.exp(np.clip(scores, -30.0, 30.0))
    (t00, t01), (t10, t11) = turns
    inner = ~first
    ahead = _scan(odds * t11 * inner, np.where(first, odds, odds * t01), t10 * inner, np.where(first, 1.0, t00))
    last = np.append(first[1:], True)
    after = np.append(odds[1:], 1.0)
    back = slice(None, None, -1)
    behind = _scan((after * t11 * ~last)[back], np.where(last, 1.0, t10)[back], (after * t01 * ~last)[back], np.where(last, 1.0, t00)[back])[back]
    both = ahead * behind
    return both / (1.0 + both), ahead, behind


def _turn_shares(scores: np.ndarray, first: np.ndarray, turns: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Expected number of turns from state i to state j."""
    odds = np.exp(np.clip(scores, -30.0, 30.0))
    to = ~first[1:]
    f, b, e = ahead[:-1][to], behind[1:][to], odds[1:][to]
    cells = np.array([[np.full(len(f), turns[0, 0]), turns[0, 1] * e * b], [turns[1, 0] * f, turns[1, 1] * f * e * b]])
    return (cells / cells.sum(axis=(0, 1))).sum(axis=2)


@dataclass(frozen=True)
class Model:
    """Weights of hashed features, turn factors and the document score's (level, weight of the sum, weight of the peak)."""

    weights: np.ndarray
    turns: np.ndarray
    score: tuple[float, float, float]


def _emissions(own: np.ndarray, ahead: np.ndarray, before: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of every token from its own weight and those its neighbours lend it."""
    out = own[ids]
    inner = ~first[1:]
    out[1:] += np.where(inner, ahead[ids[:-1]], 0.0)
    out[:-1] += np.where(inner, before[ids[1:]], 0.0)
    return out


def _fit_chain(texts: list[list[str]], toxic: list[bool], seeds: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and turn factors of largest penalised likelihood, by signs of the gradient (a step per weight)."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    lengths = [len(words) for words in texts]
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    listed = np.array([w.lower() in seeds for w in number], bool)[ids]
    held = np.repeat(np.array(toxic, bool), lengths)
    y = (listed & held).astype(float)
    flat, owner, sides = word_slots(list(number))
    weights, turns = np.zeros(FEATURES), np.zeros((2, 2))

    def scored() -> np.ndarray:
        own = np.bincount(owner, weights[flat], len(number)) + weights[_BIAS]
        return _emissions(own, weights[sides[0]], weights[sides[1]], ids, first)

    inner = ~first[1:]
    for stage, rounds in enumerate(ROUNDS):
        if stage:
            marginal = forward_backward(scored(), first, np.exp(turns))[0]
            y = (((marginal > SPAN) | listed) & held).astype(float)
        seen = np.array([[((1 - y[:-1]) * (1 - y[1:]))[inner].sum(), ((1 - y[:-1]) * y[1:])[inner].sum()], [(y[:-1] * (1 - y[1:]))[inner].sum(), (y[:-1] * y[1:])[inner].sum()]])
        step_w, step_t = np.full(FEATURES, 0.1), np.full((2, 2), 0.1)
        before_w, before_t = np.zeros(FEATURES), np.zeros((2, 2))
        for _ in range(rounds):
            scores = scored()
            marginal, ahead, behind = forward_backward(scores, first, np.exp(turns))
            miss = marginal - y
            by_word = np.bincount(ids, miss, len(number))
            slope = np.bincount(flat, by_word[owner], FEATURES)
            slope += np.bincount(sides[0][ids[:-1]], np.where(inner, miss[1:], 0.0), FEATURES)
            slope += np.bincount(sides[1][ids[1:]], np.where(inner, miss[:-1], 0.0), FEATURES)
            slope[_BIAS] += miss.sum()
            slope += PENALTY * weights
            turn_slope = _turn_shares(scores, first, np.exp(turns), ahead, behind) - seen + PENALTY * turns
            turn_slope[0, 0] = 0.0
            for value, now, past, step in ((weights, slope, before_w, step_w), (turns, turn_slope, before_t, step_t)):
                agree = now * past
                step *= np.where(agree > 0, 1.2, np.where(agree < 0, 0.5, 1.0))
                np.minimum(step, 1.0, out=step)
                value -= np.sign(now) * step
                past[...] = now
    return weights, np.exp(np.clip(turns, -20.0, 20.0))


# -- tagging ------------------------------------------------------------------------------------------------


class Tagger:
    """Tags the texts of a task; weights of words met before are remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.lent = np.empty((3, 1024))

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of words; weights of new ones are looked up."""
        get = self.number.get
        found = list(map(get, words))
        if None in found:
            fresh = list(dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None))
            known = len(self.number)
            self.number.update(zip(fresh, range(known, known + len(fresh)), strict=True))
            while self.lent.shape[1] < len(self.number):
                self.lent = np.concatenate((self.lent, np.empty_like(self.lent)), axis=1)
            slots, owner, sides = word_slots(fresh)
            weights = self.model.weights
            self.lent[0, known : len(self.number)] = np.bincount(owner, weights[slots], len(fresh)) + weights[_BIAS]
            self.lent[1:, known : len(self.number)] = weights[sides]
            found = list(map(get, words))
        return np.array(found, np.int64)

    def marginals(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Per text the marginals of its tokens, in chains of CHAIN tokens; short texts are worked on together."""
        done: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []

        def work() -> None:
            ids = self.ids([w for _, chain in waiting for w in chain])
            ends = np.cumsum([len(chain) for _, chain in waiting])
            first = np.zeros(ends[-1], bool)
            first[ends[:-1]] = first[0] = True
            marginal = forward_backward(_emissions(*self.lent, ids, first), first, self.model.turns)[0]
            for (at, _), part in zip(waiting, np.split(marginal, ends[:-1]), strict=True):
                done[at].append(part)
            waiting.clear()
            if len(self.number) > KNOWN_WORDS:
                self.forget()

        size = 0
        for at, text in enumerate(texts):
            chain: list[str] = []
            for _, words in tokens(text):
                chain += words
                while len(chain) >= CHAIN:
                    waiting.append((at, chain[:CHAIN]))
                    chain, size = chain[CHAIN:], 0
                    work()
            if chain:
                waiting.append((at, chain))
                size += len(chain)
            if size >= CHAIN:
                size = 0
                work()
        if waiting:
            work()
        return done


def _summary(parts: list[np.ndarray]) -> tuple[float, float]:
    """(log of one plus the expected number of toxic tokens, largest marginal) of a text."""
    return float(np.log1p(sum(float(p.sum()) for p in parts))), max((float(p.max()) for p in parts), default=0.0)


def _spans(text: str, parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Stretches of toxic tokens, next to each other, as (start, stop) in code points."""
    hot = np.concatenate(parts) > SPAN if parts else np.zeros(0, bool)
    if not hot.any():
        return []
    out: list[tuple[int, int]] = []
    joined = False
    for match, toxic in zip(_TOKEN.finditer(text), hot.tolist(), strict=True):
        if toxic:
            out.append((out.pop()[0], match.end()) if joined else match.span())
        joined = toxic
    return out


def _fit_score(points: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float, float]:
    """Logistic regression on (sum, peak), classes weighted so that the toxic share is that of all labelled documents."""
    x = np.hstack((np.ones((len(points), 1)), points))
    weight = np.where(toxic, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grade = x.T @ (weight * (p - toxic)) + ridge @ beta
        beta -= np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + ridge, grade)
    return tuple(float(b) for b in beta)


# -- fitting ------------------------------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def seeds(labelled: DataFrame) -> set[str]:
    """Words of ``text, toxic`` rows that mark toxic documents, by counts over all of them."""
    cut = labelled.select("toxic", _words(F.col("text")).alias("words"))
    words = F.col("words")
    seen = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.xxhash64(F.get(words, i - 1), F.get(words, i + 1)).alias("context")))
    toxic = cut.where("toxic").select(F.inline(seen)).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("contexts"))
    clean = cut.where("NOT toxic").select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("clean"))
    size = {r["toxic"]: (r["n"] or 0) + 1.0 for r in cut.groupBy("toxic").agg(F.sum(F.size("words")).alias("n")).collect()}
    surely = F.col("contexts") - CAUTION * F.sqrt("contexts")
    ratio = surely / size[True] / ((F.coalesce("clean", F.lit(0)) + 0.5) / size[False])
    rated = toxic.where(surely > 0).join(clean, "word", "left").select("word", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    return {r["word"] for r in rated.orderBy(F.desc("ratio"), "word").limit(SEEDS).collect()}


def _sample(labelled: DataFrame) -> list[tuple[str, bool]]:
    """Different short texts of both classes, the first by digest."""
    prints = labelled.where(F.octet_length("text") <= SAMPLE_BYTES).groupBy("print", "toxic").agg(F.count(F.lit(1)).alias("n"))
    prints = stored(prints, "prints")
    size = CHAIN_SAMPLE + SCORE_SAMPLE
    toxic, clean = (prints.where(F.col("toxic") == kind).orderBy("print").limit(size).drop("n") for kind in (True, False))
    rows = labelled.join(toxic.union(clean), ["print", "toxic"]).groupBy("print", "toxic").agg(F.min("text").alias("text"))
    return [(r["text"], r["toxic"]) for r in rows.orderBy("toxic", "print").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``doc_id, text`` and ``doc_id, toxic`` (1 is toxic, other values are clean, NULL is no label).

    Repeated label rows count once, the largest label holds. Without documents of both classes the score is the same for
    all texts: 1 if all are toxic, else 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known.hint("merge"), "doc_id")
    labelled = stored(labelled.select("text", "toxic", F.xxhash64("text").alias("print")), "labelled")
    count = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = count.get(True, 0) / max(1, sum(count.values()))
    if not 0 < share < 1:
        return Model(np.zeros(FEATURES), np.ones((2, 2)), (30.0 if share else -30.0, 0.0, 0.0))
    marked = seeds(labelled)
    chains: list[tuple[list[str], bool]] = []
    held_back: list[tuple[str, bool]] = []
    picked = _sample(labelled)
    for kind in (True, False):
        mine = [text for text, toxic in picked if toxic == kind]
        cut = max(1, len(mine) * CHAIN_SAMPLE // (CHAIN_SAMPLE + SCORE_SAMPLE))
        chains += [([w for _, words in tokens(text) for w in words], kind) for text in mine[:cut]]
        held_back += [(text, kind) for text in mine[cut:] or mine]
    chains = [(words, kind) for words, kind in chains if words]
    if not chains or len({kind for _, kind in held_back}) < 2:
        return Model(np.zeros(FEATURES), np.ones((2, 2)), (float(np.log(share / (1 - share))), 0.0, 0.0))
    weights, turns = _fit_chain([words for words, _ in chains], [kind for _, kind in chains], marked)
    plain = Tagger(Model(weights, turns, (0.0, 0.0, 0.0)))
    points = np.array([_summary(parts) for parts in plain.marginals([text for text, _ in held_back])])
    return Model(weights, turns, _fit_score(points, np.array([kind for _, kind in held_back]), share))


def tagged(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and ``out``: score (0 to 1), n_tokens, expected number of toxic tokens, spans (code points, stop not included).

    The whole text is tagged, in chains of CHAIN tokens. NULL and texts without a word have no spans and the score that a
    text without toxic tokens gets. Repeated rows get equal results; ``out`` replaces a column of that name.
    """
    level, total, peak = model.score
    tagger: list[Tagger] = []

    @F.pandas_udf(TAGS)
    def tag(texts: pd.Series) -> pd.DataFrame:
        if not tagger:
            tagger.append(Tagger(model))
        whole = [t or "" for t in texts]
        rows = []
        for text, parts in zip(whole, tagger[0].marginals(whole), strict=True):
            summed, top = _summary(parts)
            score = 1 / (1 + np.exp(-np.clip(level + total * summed + peak * top, -30, 30)))
            rows.append((float(score), sum(len(p) for p in parts), float(np.expm1(summed)), [{"start": a, "stop": b} for a, b in _spans(text, parts)]))
        return pd.DataFrame(rows, columns=["score", "n_tokens", "expected", "spans"])

    return docs.withColumn(out, tag(F.col(text_col)))
