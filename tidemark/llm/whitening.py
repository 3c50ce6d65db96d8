"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The matrix is the distinct vectors, centred; it is never held anywhere whole. Each step multiplies it with a vector of
its row space and its transpose with the vector of its column space that this gives (``C v`` and ``C^T u``), both in one
pass over the stored rows. Vectors of the column space, one entry per row, are kept as what they are products of:
u_j = C p_j, with p_j as short as a row. So their products with the new vector are measured on the rows in every pass,
and both bases are orthogonalised in full. The driver sees a few vectors as long as a row, and the singular vectors of
a small bidiagonal matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import stored

# Bytes of a stored block of rows.
BLOCK = 1 << 16
# Residual of a singular vector, relative to the largest singular value, at which it counts as found.
PRECISION = 4e-16
# Share of a new vector that lies in the basis, from which one correction is not enough.
LOOSE = 1e-6
_LONG = 1 << 63
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Fit:
    """What whitening needs: number of fitted vectors, their exact sums, and per component its direction, variance and share."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of every entry as long; NULL for a vector that is NULL or holds a NULL or non-finite entry."""
    entries = vector.cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(sound, F.transform(entries, lambda c: F.floor(c * float(scale)).cast("long")))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("data").to_pylist()), np.int64).reshape(-1, width)


def blocks(x: DataFrame, width: int) -> DataFrame:
    """The distinct vectors of column ``x``, stored as packed blocks; copies combine before they are shuffled."""
    rows = max(1, BLOCK // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)
            parts = [flat[i : i + rows].tobytes() for i in range(0, len(flat), rows)]
            yield pa.RecordBatch.from_pydict({"data": pa.array(parts, pa.binary())})

    return stored(x.select("x").distinct().mapInArrow(pack, "data binary"), "vectors")


def totals(packed: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = _matrix(batch, width)
            wide = len(x) and int(np.abs(x.astype(float)).max()) * len(x) >= _LONG // 2
            n, sums = n + len(x), [a + int(b) for a, b in zip(sums, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"s": pa.array([[Decimal(v) for v in (n, *sums)]], pa.list_(pa.decimal128(38, 0)))})

    parts = packed.mapInArrow(add, "s array<decimal(38,0)>")
    row = parts.agg(*[F.sum(F.col("s")[i]) for i in range(width + 1)]).first()
    found = [int(v or 0) for v in row]
    return found[0], found[1:]


def _summed(packed: DataFrame, mean: np.ndarray, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of what ``of`` makes of centred rows: ``size`` numbers, one row a task goes on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(_matrix(batch, len(mean)) - mean)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total], pa.list_(pa.float64()))})

    parts = packed.mapInArrow(work, "s array<double>")
    return np.array(parts.agg(*[F.sum(F.col("s")[i]) for i in range(size)]).first(), dtype=float)


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonal(packed: DataFrame, mean: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` singular values of the centred rows and their right singular vectors (as rows).

    Step k turns v_k into u_k (C v_k less its part in earlier u), and u_k into v_(k+1) (C^T u_k less its part in earlier
    v). The lengths that are left, alpha_k and beta_k, form the bidiagonal matrix whose singular vectors give those of C.
    Ends when the residuals of all wanted vectors are at the precision of doubles, or when the v span the whole row space.
    """
    width = len(mean)
    draw = np.random.default_rng(1)
    V, P, Z = np.zeros((0, width)), np.zeros((0, width)), np.zeros((0, width))  # v_k; p_k with u_k = C p_k; C^T u_k
    alphas: list[float] = []
    betas: list[float] = []
    v, coupled = draw.normal(size=width), 0.0
    v /= np.linalg.norm(v)

    def products(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For w = C p: C^T w, the parts of w along all u, and its squared length."""
        past = np.zeros((width, width))
        past[: len(P)] = P

        def of(rows: np.ndarray) -> np.ndarray:
            w = rows @ p
            return np.concatenate((w @ rows, (rows @ past.T).T @ w, [w @ w]))

        out = _summed(packed, mean, 2 * width + 1, of)
        return out[:width], out[width : width + len(P)], float(out[-1])

    while True:
        V = np.vstack((V, v))
        p = v - coupled * P[-1] if len(P) else v
        for _ in range(3):
            back, along, square = products(p)
            length = max(square - float(along @ along), 0.0) ** 0.5
            p, back = p - P.T @ along, back - Z.T @ along
            if np.linalg.norm(along) <= LOOSE * length:
                break
        scale = max([length, *alphas, *betas])
        if length <= 10 * width * EPS * scale:
            alpha, p, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            alpha, p, z = length, p / length, back / length
        P, Z = np.vstack((P, p)), np.vstack((Z, z))
        alphas.append(alpha)
        rest = _orthogonal(z - alpha * v, V)
        beta = float(np.linalg.norm(rest))
        stuck = beta <= 10 * width * EPS * scale
        left, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if len(V) == width:
            break
        if not stuck and len(V) >= wanted and (beta * np.abs(left[-1, :wanted])).max() <= PRECISION * values[0]:
            break
        # An invariant subspace is exhausted: go on from a direction that it does not hold.
        v = _orthogonal(draw.normal(size=width), V) if stuck else rest
        v /= np.linalg.norm(v)
        coupled = 0.0 if stuck else beta
        betas.append(coupled)
    return values[:wanted], (right @ V)[:wanted]


def fit(x: DataFrame, width: int, components: int = 4) -> Fit | None:
    """Principal directions of the distinct vectors of column ``x``, all of length ``width``; None without any vector."""
    packed = blocks(x, width)
    n, sums = totals(packed, width)
    if n == 0:
        return None
    mean = np.array([s / n for s in sums])
    values, directions = bidiagonal(packed, mean, min(components, width))
    kept = values > 100 * width * EPS * max(values.max(), np.abs(mean).max())
    values, directions = values[kept], directions[kept]
    m = len(values)
    variances = values**2 / n

    def of(rows: np.ndarray) -> np.ndarray:
        z = rows @ directions.T / np.sqrt(variances)
        return np.concatenate(((z.T @ z).ravel(), z.sum(axis=0), [np.square(rows).sum()]))

    out = _summed(packed, mean, m * m + m + 1, of)
    off = out[: m * m].reshape(m, m) / n - np.outer(out[m * m : -1], out[m * m : -1]) / n**2 - np.eye(m)
    share = values**2 / out[-1] if m else values
    return Fit(n, tuple(sums), directions, variances, share, float(np.abs(off).max()) if m else 0.0)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """sum((n * x - S)^2) per row, exact; None where that does not fit in a long."""
    bound = n * int(np.abs(x.astype(float)).max(initial=0)) + max(abs(s) for s in sums)
    if bound * bound * len(sums) < _LONG:
        return np.square(x * n - np.array(sums, np.int64)).sum(axis=1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < _LONG else None for v in exact]


def whitened(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = 4, scale: int = 256) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become the integers floor(scale * entry). Vectors that are NULL, or hold NULL or non-finite entries, are left
    out, and so are those whose length is not the most common one (ties: the longest). Components are the directions
    of the largest variances of the distinct vectors, from 1, either sign; ``whitened`` is the centred vector along
    it over its deviation. Fewer distinct directions give fewer components: without any variation (a single vector, no
    vector, empty vectors) there are no rows. Ids may be NULL or repeated; ``deviation`` is NULL where it exceeds a long.
    """
    whole = rows.select(F.col(id_col).alias("vec_id"), integers(F.col(vector), scale).alias("x")).where(F.col("x").isNotNull())
    sizes = whole.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    width = common["width"] if common else 0
    found = fit(whole.where(F.size("x") == width), width, components) if width else None
    schema = T.StructType([T.StructField("vec_id", whole.schema["vec_id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if found is None or len(found.variances) == 0:
        return whole.sparkSession.createDataFrame([], schema).select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")
        )
    mean, onto = found.mean, found.directions.T / np.sqrt(found.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)
            z = (x - mean) @ onto
            columns = [batch.column("vec_id"), pa.array(_deviations(x, found.n, found.sums), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    projected = whole.where(F.size("x") == width).mapInArrow(project, schema)
    shares = F.array(*[F.lit(float(s)) for s in found.explained])
    return projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
