"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted, deleted or replaced letter changes the vector of letter counts by an L1 distance of at most two: one
count goes up by one, or one goes down by one, or both. So for every pair of lengths (n, n) and (n, n + 1) the words
near a word lie in a small box around its vector. A k-d tree prunes the boxes that are too far away, and what is left
is compared letter by letter.

Letters are folded to 32 counts (a to z on their own), each kept up to four: both only make distances smaller, so no
near word is missed. Counts are held in unary, so that distances to points and to boxes are bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import stored

DIMS, LEVELS = 32, 4

# Words of one length from which its space is cut into cells, each searched by a task of its own.
CELL = 16_384
# Words (about so many, by their digests) the cuts between cells are taken from. They balance the cells and decide nothing else.
SAMPLE = 100_000
# Points, queries and letters of either that a task holds; a cell with more is searched in blocks of both.
POINTS, QUERIES, LETTERS = 1 << 16, 1 << 18, 1 << 24
# Points of a leaf within a task, and pairs compared in one go.
LEAF, PAIRS = 128, 1 << 20

POINT, SAME, SHORTER = 0, 1, 2
# Of a query of each kind: by how much counts of a point may exceed it and fall short of it.
REACH = {SAME: (1, 1), SHORTER: (1, 0)}


# -- words of a corpus --------------------------------------------------------------------------------------


def runs(text: Column) -> Column:
    """Maximal runs of Latin letters of a whole text, A to Z in lower case."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit("([a-zÀ-ÿ]+)"), F.lit(1))


def worn(run: Column, doc_id: Column, every: int) -> Column:
    """Runs of which every so many-th, by a digest of document and run, has lost one letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, wear: int | None = None) -> DataFrame:
    """(word, n) of the runs in ``doc_id, text``. NULL and blank texts have none; counts combine before they are shuffled."""
    run = F.col("run")
    cut = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    words = cut.select((run if wear is None else worn(run, F.col("doc_id"), wear)).alias("word"))
    counted = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# -- letter counts ------------------------------------------------------------------------------------------


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def _vectors(letters: np.ndarray) -> np.ndarray:
    plain = letters - np.uint32(97)
    dims = np.where(plain < 26, plain, 26 + letters % np.uint32(DIMS - 26)).astype(np.int64)
    flat = np.bincount((dims + np.arange(len(letters))[:, None] * DIMS).ravel(), minlength=len(letters) * DIMS)
    return np.minimum(flat.reshape(len(letters), DIMS), LEVELS).astype(np.int8)


def _unary(vectors: np.ndarray) -> np.ndarray:
    """Counts as bits: as many ones as the count says, two 64-bit words a vector."""
    bits = vectors[..., None] > np.arange(LEVELS, dtype=np.int8)
    return np.packbits(bits.reshape(*vectors.shape[:-1], DIMS * LEVELS), axis=-1).view(np.uint64)


def _size(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[..., 0]) + np.bitwise_count(bits[..., 1])


@dataclass
class Node:
    """A box, and either the two halves of it or (in a leaf) the rows it holds."""

    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray | None = None
    cell: int = 0
    dim: int = 0
    bound: int = 0
    halves: list[Node] = field(default_factory=list)

    def reached(self, queries: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
        """Which queries may have near points in the box."""
        return (_size(self.low & ~queries) <= reach[0]) & (_size(queries & ~self.high) <= reach[1])


def _cut(vectors: np.ndarray) -> tuple[int, int] | None:
    """Dimension and bound that part the vectors most evenly among those that vary most; None if all are equal."""
    spread = vectors.astype(np.float32).var(axis=0)
    dim = int(spread.argmax())
    if spread[dim] == 0:
        return None
    values = np.bincount(vectors[:, dim], minlength=LEVELS + 1).cumsum()[:LEVELS]
    return dim, int(np.abs(values - len(vectors) / 2).argmin())


def grow(vectors: np.ndarray, leaf: int, tight: bool) -> list[Node]:
    """A k-d tree, root first. Boxes are those of the points (``tight``) or of the cuts, for points still to come."""
    open_low, open_high = np.zeros(DIMS, np.int8), np.full(DIMS, LEVELS, np.int8)
    root = Node(open_low, open_high, np.arange(len(vectors)))
    nodes, work = [], [root]
    while work:
        node = work.pop()
        nodes.append(node)
        inside = vectors[node.rows]
        low, high = (inside.min(axis=0), inside.max(axis=0)) if tight and len(inside) else (node.low, node.high)
        cut = _cut(inside) if len(inside) > leaf else None
        if cut is not None:
            node.dim, node.bound = cut
            below = inside[:, node.dim] <= node.bound
            left, right = Node(low.copy(), high.copy(), node.rows[below]), Node(low.copy(), high.copy(), node.rows[~below])
            left.high[node.dim], right.low[node.dim] = node.bound, node.bound + 1
            node.halves, node.rows = [left, right], None
            work += [right, left]
        node.low, node.high = _unary(low), _unary(high)
    return nodes


# -- cells: the upper levels of the trees -------------------------------------------------------------------


def cells(words: DataFrame) -> dict[int, Node]:
    """For lengths of many words the upper part of their tree, cut at medians of a sample."""
    length = F.length("word")
    many = {r["length"]: r["n"] for r in words.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).collect()}
    if not many:
        return {}
    part = min(1.0, SAMPLE / sum(many.values()))
    picked = words.where(length.isin(list(many)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) <= int(part * (1 << 30)))).select("word").collect()
    by_length: dict[int, list[str]] = {}
    for row in picked:
        by_length.setdefault(len(row["word"]), []).append(row["word"])
    trees = {}
    for size, some in by_length.items():
        nodes = grow(_vectors(_letters(some, size)), max(1, len(some) * CELL // many[size]), tight=False)
        for number, leaf in enumerate(n for n in nodes if not n.halves):
            leaf.cell, leaf.rows = number, None
        trees[size] = nodes[0]
    return trees


def _home(tree: Node | None, vectors: np.ndarray) -> np.ndarray:
    """The cell every vector lies in."""
    found = np.zeros(len(vectors), np.int64)
    work = [] if tree is None else [(tree, np.arange(len(vectors)))]
    while work:
        node, rows = work.pop()
        if not node.halves:
            found[rows] = node.cell
            continue
        below = vectors[rows, node.dim] <= node.bound
        work += [(node.halves[0], rows[below]), (node.halves[1], rows[~below])]
    return found


def _visits(tree: Node | None, bits: np.ndarray, reach: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Every cell that may hold near points, with the queries for it."""
    work = [(tree, np.arange(len(bits)))]
    while work:
        node, rows = work.pop()
        if node is None:
            yield 0, rows
            continue
        rows = rows[node.reached(bits[rows], reach)]
        if len(rows) and node.halves:
            work += [(half, rows) for half in node.halves]
        elif len(rows):
            yield node.cell, rows


def routed(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """Every word once as a point of its cell, and as a query for each cell of its own length and the next that it may have near words in."""

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= POINTS:
                yield pd.concat(held)
                held, n = [], 0
        if n:
            yield pd.concat(held)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches):
            for size, rows in batch.groupby(batch["word"].str.len()):
                letters = _letters(rows["word"].tolist(), size)
                vectors = _vectors(letters)
                bits = _unary(vectors)
                yield rows.assign(length=size, cell=_home(trees.get(size), vectors), role=POINT)
                for role, of in ((SAME, size), (SHORTER, size + 1)):
                    for cell, some in _visits(trees.get(of), bits, REACH[role]):
                        yield rows.iloc[some].assign(length=of, cell=cell, role=role)

    return words.select("word", "n").mapInPandas(route, "word string, n long, length int, cell int, role int")


# -- search within a cell -----------------------------------------------------------------------------------


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``a`` is ``b`` without one letter: what they share from the left and from the right covers ``a``."""
    left, right = np.logical_and.accumulate(a == b[:, :-1], axis=1), np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)
    return left.sum(axis=1) + right.sum(axis=1) >= a.shape[1]


def near_pairs(points: list[str], queries: list[str], role: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of (query, point) one edit apart. All points have one length; queries have it too, or one letter fewer."""
    if not points or not queries:
        return
    here, there = _letters(points, len(points[0])), _letters(queries, len(queries[0]))
    reach, same = REACH[role], _one_replaced if role == SAME else _one_missing
    vectors = _vectors(here)
    spots, asked = _unary(vectors), _unary(_vectors(there))
    work = [(grow(vectors, LEAF, tight=True)[0], np.arange(len(queries)))]
    while work:
        node, rows = work.pop()
        rows = rows[node.reached(asked[rows], reach)]
        if node.halves:
            work += [(half, rows) for half in node.halves] if len(rows) else []
            continue
        step = max(1, PAIRS // len(node.rows))
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            q, p = np.nonzero(_size(asked[some][:, None] ^ spots[node.rows]) <= sum(reach))
            q, p = some[q], node.rows[p]
            for part in range(0, len(q), max(1, LETTERS // here.shape[1])):
                piece = slice(part, part + max(1, LETTERS // here.shape[1]))
                good = same(there[q[piece]], here[p[piece]])
                yield q[piece][good], p[piece][good]


def _ranked(words: list[str], n: list[int]) -> tuple[list[int], np.ndarray]:
    """Rows by falling n, then by code points, and the place of each row in that order."""
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return order, place


FOUND = "word string, n_near long, best_n long, best string"


def search(block: pd.DataFrame) -> pd.DataFrame:
    """What a cell adds to its words: how many near words, and the first of them by falling n."""
    sides = {role: (rows["word"].tolist(), rows["n"].tolist()) for role, rows in block.groupby("role")}
    points = sides.get(POINT, ([], []))
    out = []
    for role in (SAME, SHORTER):
        queries = sides.get(role, ([], []))
        ends = (queries, points) if role == SHORTER else (queries,)
        ranks = [_ranked(*points), _ranked(*queries)]
        count = [np.zeros(len(e[0]), np.int64) for e in ends]
        best = [np.full(len(e[0]), np.iinfo(np.int64).max) for e in ends]
        for q, p in near_pairs(points[0], queries[0], role):
            for side, (mine, other) in enumerate(((q, p), (p, q))[: len(ends)]):
                count[side] += np.bincount(mine, minlength=len(count[side]))
                np.minimum.at(best[side], mine, ranks[side][1][other])
        for side, (mine, other) in enumerate(((queries, points), (points, queries))[: len(ends)]):
            for i in np.flatnonzero(count[side]):
                j = ranks[side][0][best[side][i]]
                out.append((mine[0][i], int(count[side][i]), other[1][j], other[0][j]))
    return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for every word of (word, n) that has near words; no pair is ever a row."""
    spread = stored(routed(words, cells(words)), "routed")
    role = F.col("role")
    held = spread.groupBy("length", "cell").agg(F.count_if(role == POINT).alias("points"), F.count_if(role != POINT).alias("queries"))
    room = lambda most: F.greatest(F.least(F.lit(most), F.lit(LETTERS) / F.col("length")), F.lit(1))
    blocks = held.where("points > 0 AND queries > 0").select(
        "length", "cell", F.ceil(F.col("points") / room(POINTS)).alias("p_blocks"), F.ceil(F.col("queries") / room(QUERIES)).alias("q_blocks")
    )
    mine = F.when(role == POINT, F.col("p_blocks")).otherwise(F.col("q_blocks"))
    other = F.when(role == POINT, F.col("q_blocks")).otherwise(F.col("p_blocks"))
    placed = spread.join(blocks, ["length", "cell"]).withColumns({"mine": F.pmod(F.xxhash64("word"), mine), "other": F.explode(F.sequence(F.lit(0).cast("long"), other - 1))})
    p_block, q_block = F.when(role == POINT, F.col("mine")).otherwise(F.col("other")), F.when(role == POINT, F.col("other")).otherwise(F.col("mine"))
    found = placed.withColumns({"p_block": p_block, "q_block": q_block}).select("length", "cell", "p_block", "q_block", "role", "word", "n")
    found = found.groupBy("length", "cell", "p_block", "q_block").applyInPandas(search, FOUND)
    first = F.min(F.struct((-F.col("best_n")).alias("down"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.down")).alias("best_n"), F.col("first.best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word reached along forms.

    Roots are handed down level by level. A word has few near words, so no parent is a hot key, and as counts at
    least double along a chain the levels are few.
    """
    waiting = forms.where(F.col("form").isNotNull()).select("word", "form")
    known = forms.where(F.col("form").isNull()).select("word", F.col("word").alias("root"))
    done = known
    while True:
        known = stored(waiting.join(known.withColumnRenamed("word", "form"), "form").select("word", "root"), "roots")
        if known.isEmpty():
            return done
        done = done.union(known)


def grouped(words: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of distinct (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near
    word of the largest n (ties: the first by code points), if that is ``times`` the word's own n or more; its root the
    last word along forms, itself without one. No words give no rows; any length and script is taken.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    joined = words.join(neighbours(words), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    formed = joined.select(
        "word",
        F.when(is_form, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    formed = stored(formed, "formed")
    return formed.join(rooted(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
