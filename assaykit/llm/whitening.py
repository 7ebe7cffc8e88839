"""Whitening of embeddings by shifted Cholesky QR.

Entries are put on an integer grid, so sums over rows are exact. The rows to fit (each distinct
vector once) are centred and their triangular factor R is found in a few distributed passes: a pass
solves every centred row against the factors found so far and adds up the d x d products of the
result, and the Cholesky factor of that Gram matrix joins the product. The first Gram matrix gets a
small shift, so it can be factored whatever its condition; the later passes take the shift's effect
out again. When the rows are orthonormal, R of all rows is known, and its SVD gives the components
and, from its singular values, the variances.

A task sends one d x d matrix, whatever its rows; these are added up by entry in an aggregation. The
driver holds d x d numbers (``MAX_DIM`` bounds them) and no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, stored

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_DIM = 4096        # 128 MB a matrix
PASSES = 10           # Gram passes at most; three are usual
ROUNDING = 1e-12      # rows count as orthonormal when their Gram matrix is this close to the identity
NOTHING = 1e-18       # squared length, against one, under which a direction holds nothing
NOISE = 1e-12         # deviation, against the largest, that rounding alone can make
EPS = np.finfo(float).eps
FITS = 2.0 ** 55      # entries below this have a grid value that is a long with room


def usable(vec: Column) -> Column:
    """There, not empty, and all entries there, finite and within the grid."""
    entries = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < FITS), F.lit(False)))
    return F.coalesce((F.size(vec) > 0) & entries, F.lit(False))


def on_grid(vec: Column, grid: int = GRID, offset: int = OFFSET) -> Column:
    return F.transform(vec, lambda c: F.floor(c.cast("double") * grid) + offset)


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Centre:
    """Rows less their exact mean: x - S/n = (x - S // n) - (S mod n) / n, without large numbers in between."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S) squared, exact; None where a long can't hold it."""
        apart = x - self.whole
        most = (np.abs(apart).max(initial=0).item() + 1) * self.n
        if most * most * x.shape[1] < 2 ** 63:
            return ((self.n * apart - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in apart]
        return [v if v < 2 ** 63 else None for v in exact]


def right_solve(y: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """Rows q with q R = y for an upper triangular R, by forward substitution over the columns."""
    q = np.empty_like(y)
    for a in range(0, y.shape[1], block):
        b = min(a + block, y.shape[1])
        part = y[:, a:b] - q[:, :a] @ r[:a, a:b]
        for j in range(b - a):
            part[:, j] = (part[:, j] - part[:, :j] @ r[a:a + j, a + j]) / r[a + j, a + j]
        q[:, a:b] = part
    return q


def cholesky(gram: np.ndarray, first: bool) -> np.ndarray:
    """The upper triangular factor. The first Gram matrix is shifted, a later one only if it can't be factored as it is."""
    d, norm = len(gram), float(np.trace(gram))
    if not first and np.linalg.eigvalsh(gram)[0] > d * EPS * norm:
        return np.linalg.cholesky(gram).T
    shift = (11 * d * (d + 1) if first else 4 * d) * EPS * norm
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension; a task sends one row a dimension, in two halves that can't overflow."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = rows_of(batch.column(0), dim)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim, dtype=np.int32), "n": np.full(dim, n, np.int64), "high": high, "low": low})

    wide = T.DecimalType(38, 0)
    sums = fit.select("x").mapInArrow(partial, "i int, n long, high long, low long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    rows = sorted(sums.collect())  # one row a dimension
    return rows[0]["n"], [int(r["high"]) * 2 ** 32 + int(r["low"]) for r in rows]


def gram(fit: DataFrame, dim: int, turned: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the rows of the products of ``turned`` rows, as a width x width matrix."""
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            q = turned(rows_of(batch.column(0), dim))
            total += q.T @ q
        yield pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "v": total[upper]})

    sums = fit.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for i, j, v in sums.collect():  # width x width entries
        out[i, j] = out[j, i] = v
    return out


def triangular(fit: DataFrame, dim: int, centre: Centre) -> np.ndarray:
    """R with R'R the sum of the products of the centred rows."""
    factors: list[np.ndarray] = []
    product = np.eye(dim)

    def turned(x: np.ndarray) -> np.ndarray:
        y = centre.rows(x)
        for r in factors:
            y = right_solve(y, r)
        return y

    for i in range(PASSES):
        g = gram(fit, dim, turned, dim)
        if not np.trace(g) > 0:
            return np.zeros((dim, dim))  # all rows are equal
        lengths = np.linalg.eigvalsh(g)
        done = i > 0 and bool(((np.abs(lengths - 1) < ROUNDING) | (lengths < NOTHING)).all())
        factors = [*factors, cholesky(g, i == 0)]
        product = factors[-1] @ product
        if done:
            break
    return product


def whiten(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS, grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(grid c) + offset. The fit takes every distinct x vector once, so
    copies don't weigh; all rows, copies and rows without an id included, are then whitened. Vectors
    that are null, empty or hold null, non-finite or enormous (2^55 and over) entries are left out.
    Components come by falling variance, with the sign that makes their largest entry positive; there
    are ``components`` of them, or as many as dimensions. One without any variance (n = 1, constant or
    dependent dimensions) explains 0 and has no whitened value (null); it doesn't count for
    identity_error. deviation is null where a long can't hold it. Vectors of different lengths have no
    common covariance and raise a ValueError, as do over ``MAX_DIM`` dimensions. An empty table, or one
    without a usable vector, gives no rows.
    """
    usable_rows = vectors.filter(usable(col(vec))).select(col(id).alias("id"), on_grid(col(vec), grid, offset).alias("x"))
    fit = stored(usable_rows.select("x").distinct(), "whitening-fit")
    lengths = sorted(r[0] for r in fit.select(F.size("x")).distinct().limit(2).collect())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths}")
    dim = lengths[0] if lengths else 1
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions, at most {MAX_DIM} are possible")
    k = min(components, dim)
    n, sums = moments(fit, dim) if lengths else (1, [0])
    centre = Centre(n, sums)
    r = triangular(fit, dim, centre) if lengths else np.zeros((1, 1))

    _, lengths_, axes = np.linalg.svd(r)
    variance = lengths_ ** 2 / n
    rank = min(k, int((lengths_ > NOISE * lengths_[0]).sum())) if lengths_[0] > 0 else 0
    signs = np.sign(axes[np.arange(dim), np.abs(axes).argmax(1)])
    turn = (axes * signs[:, None])[:rank].T / np.sqrt(variance[:rank])
    explained = [float(v / variance.sum()) if i < rank else 0.0 for i, v in enumerate(variance[:k])]
    error = float(np.abs(gram(fit, dim, lambda x: centre.rows(x) @ turn, rank) / n - np.eye(rank)).max()) if rank else 0.0

    result = T.StructType([T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(result)
    def projected(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in rows:
            x = rows_of(batch, dim)
            values = np.full((len(x), k), np.nan)
            values[:, :rank] = centre.rows(x) @ turn
            flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(centre.deviation(x), pa.int64()), lists], ["deviation", "whitened"])

    done = usable_rows.withColumn("out", projected("x")).select("id", F.col("out.deviation").alias("deviation"), F.posexplode("out.whitened").alias("place", "whitened"))
    return done.select(F.col("id").alias(id), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(F.array(*map(F.lit, explained)), F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
