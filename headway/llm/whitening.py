"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of their centred rows.

Components c become integers x = floor(scale * c) + offset, which are packed to matrix blocks once and written
to the shared folder; sums S of n rows are exact.  A is the matrix of the rows x - S/n.  Step j takes w, the new right vector
less what the last left vector holds of it, and every task returns of its rows

    A'(A w),  U'(A w)  and  |A w|^2,

sums of dimensions + steps + 1 numbers, whatever the rows.  U'(A w) takes the new left vector's part in all
earlier ones away, so that A w and the product A'u of the reorthogonalised u come from one pass: a left vector has as many
entries as there are rows, and is kept as the w that gives it (u = A w), never as a table.  Right vectors are
made orthogonal to all earlier ones twice.  The singular values of the small bidiagonal matrix over sqrt(n) are the
deviations; its right vectors turn the right vectors into components.

A run of at most ``STEPS`` dimensions goes to its end and so finds every component, equal ones too: where
a residual vanishes, a new vector orthogonal to all others starts the next part of the matrix.  With more dimensions
a run stops as soon as the wanted values have converged, and further runs, orthogonal to what is found,
show that no larger one was missed.

Edge cases: vectors that are null, empty, or hold a null, non-finite or too large entry (x has to be exact as
a double) take no part; neither do those whose length isn't the most frequent one (of equally frequent ones the
longest).  Components without variance aren't given, so constant vectors give no rows.  Repeated rows count each time.
A null id stays null; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import stored

#: Dimensions up to which a run is never stopped early.
STEPS = 256
#: Bytes of a block of rows.
BLOCK = 1 << 22
#: What counts as nothing, against the norm of all rows.
NOTHING = 1e-10
CONVERGED = 1e-13
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """A fit: exact sums, components (columns, by falling deviation), and what they explain."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def usable(vector: Column, scale: float) -> Column:
    most = (1 << 52) / scale
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) <= most, F.lit(False))), F.lit(False))


def _packing(dims: int, scale: float, offset: int):
    rows = max(1, BLOCK // (8 * dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.floor(values * scale).astype(np.int64) + offset
            for a in range(0, len(x), rows):
                part, ids = x[a : a + rows], batch.column(0).slice(a, rows)
                listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([listed, pa.array([part.tobytes()], pa.binary())], ["ids", "x"])

    return run


def packed(spark: SparkSession, vectors: DataFrame, scale: float, offset: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """Blocks (ids, x), stored, of all usable rows, and the number of their dimensions (0: no rows)."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(usable(F.col("v"), scale))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims, kind = length.d if length else 0, rows.schema["id"].dataType.simpleString()
    if not dims:
        return spark.createDataFrame([], f"ids array<{kind}>, x binary"), 0
    return stored(spark, rows.where(F.size("v") == dims).mapInArrow(_packing(dims, scale, offset), f"ids array<{kind}>, x binary")), dims


class _Rows:
    """The matrix of centred rows; every method is one pass over the blocks, and returns sums of what tasks return."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims, self.passes = blocks.select("x"), dims, 0
        high, low, n = np.split(self._sum(lambda x: np.concatenate([(x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0), [len(x)]]), np.int64), [dims, 2 * dims])
        self.n, self.sums = int(n[0]), [(int(h) << 26) + int(l) for h, l in zip(high, low, strict=True)]
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([s % self.n / self.n for s in self.sums])

    def _sum(self, f: Callable[[np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray:
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block in batch.column(0):
                    own = f(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dims))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.ascontiguousarray(total, kind).tobytes()], pa.binary())], ["task", "total"])

        self.passes += 1
        return sum(np.frombuffer(bytes(r.total), kind) for r in sorted(self.blocks.mapInArrow(run, "task int, total binary").collect(), key=lambda r: r.task))

    def squares(self) -> float:
        base, part = self.base, self.part
        return float(self._sum(lambda x: np.array([((x - base - part) ** 2).sum()]))[0])

    def step(self, w: np.ndarray, lefts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        base, part = self.base, self.part

        def own(x: np.ndarray) -> np.ndarray:
            a = (x - base) - part
            p = a @ w
            return np.concatenate([a.T @ p, lefts.T @ (a.T @ p) if lefts.shape[1] > a.shape[0] else (a @ lefts).T @ p, [p @ p]])

        got = self._sum(own)
        return got[: self.dims], got[self.dims : -1], float(got[-1])

    def products(self, columns: np.ndarray) -> np.ndarray:
        """The covariance of the rows' products with some columns."""
        base, part, k = self.base, self.part, columns.shape[1]

        def own(x: np.ndarray) -> np.ndarray:
            z = ((x - base) - part) @ columns
            return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

        got = self._sum(own) / self.n
        return got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :])


def _fresh(rng: np.random.Generator, *known: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to all columns that are known."""
    v = rng.standard_normal(known[0].shape[0])
    for _ in range(2):
        for k in known:
            v = v - k @ (k.T @ v)
    return v / np.linalg.norm(v)


def _run(rows: _Rows, found: np.ndarray, k: int, nothing: float, rng: np.random.Generator) -> tuple[bool, np.ndarray, np.ndarray]:
    """Bidiagonalises the rows orthogonally to what is found: (whether to the end, singular values, right vectors)."""
    dims = rows.dims
    steps = dims - found.shape[1]
    rights, lefts, images = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    v, beta, b = _fresh(rng, found), 0.0, np.zeros((steps, steps))
    for j in range(steps):
        w = v - beta * lefts[:, -1] if beta else v
        for _ in range(3):
            image, shared, square = rows.step(w, lefts)
            w, image = w - lefts @ shared, image - images @ shared
            if shared @ shared <= 1e-12 * square:
                break
        alpha = np.sqrt(max(square - shared @ shared, 0.0))
        if alpha <= nothing:  # all of A v is in earlier left vectors
            alpha, w, image, r = 0.0, np.zeros(dims), np.zeros(dims), np.zeros(dims)
        else:
            w, image = w / alpha, image / alpha
            r = image - alpha * v
        rights, lefts, images = np.column_stack([rights, v]), np.column_stack([lefts, w]), np.column_stack([images, image])
        for _ in range(2):
            r = r - rights @ (rights.T @ r)
            r = r - found @ (found.T @ r)
        beta, b[j, j] = float(np.linalg.norm(r)), alpha
        if j + 1 == steps:
            break
        if dims > STEPS and j + 1 >= k:
            left, values, right = np.linalg.svd(b[: j + 1, : j + 1])
            if np.all(beta * np.abs(left[-1, :k]) <= CONVERGED * max(values[0], nothing)):
                return False, values[:k], rights @ right[:k].T
        beta = beta if beta > nothing else 0.0
        b[j, j + 1], v = beta, r / beta if beta else _fresh(rng, rights, found)
    _, values, right = np.linalg.svd(b)
    return True, values[:k], rights @ right[:k].T


def fit(blocks: DataFrame, dims: int, k: int, *, seed: int = 11) -> Whitening | None:
    """The first k components of all rows of the blocks; None without rows."""
    if not dims:
        return None
    rows, rng = _Rows(blocks, dims), np.random.default_rng(seed)
    squares = rows.squares()
    nothing = NOTHING * np.sqrt(squares)
    values, vectors, whole = np.zeros(0), np.zeros((dims, 0)), squares == 0
    while not whole and vectors.shape[1] < dims:
        whole, more, right = _run(rows, vectors, min(k, dims - vectors.shape[1]), nothing, rng)
        least = values[k - 1] if len(values) >= k else -1.0
        values, vectors = np.concatenate([values, more]), np.column_stack([vectors, right])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        whole = whole or more[0] <= least * (1 + 1e-9)
    some = values[:k] > nothing
    values, vectors = values[:k][some], vectors[:, :k][:, some]
    deviations = values / np.sqrt(rows.n)
    error = 0.0
    if len(values):
        white = rows.products(vectors / deviations)
        error = float(np.abs(white - np.eye(len(values))).max())
    return Whitening(rows.n, rows.sums, vectors, deviations, values**2 / squares if squares else values, error, rows.passes)


def _whitened(fit: Whitening):
    n, dims = fit.n, len(fit.sums)
    base, rest = np.array([s // n for s in fit.sums], np.int64), np.array([s % n for s in fit.sums], np.int64)
    part, columns = rest / n, fit.components / fit.deviations
    k, rows = columns.shape[1], max(1, BLOCK // (8 * columns.shape[1]))

    def squares(x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None beyond a long."""
        moved = x - base
        most = n * (int(np.abs(moved).max()) + 1)
        if most * most * dims > LONG:
            exact = ((moved.astype(object) * n - rest) ** 2).sum(1)
            return [int(s) if s <= LONG else None for s in exact]
        return ((moved * n - rest) ** 2).sum(1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dims)
                for a in range(0, len(own), rows):
                    x = own[a : a + rows]
                    each = pa.array(np.repeat(np.arange(len(x)), k))
                    z = ((x - base) - part) @ columns
                    yield pa.RecordBatch.from_arrays([ids.values.slice(a, len(x)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(squares(x), pa.int64()).take(each), pa.array(z.ravel())], ["vec_id", "component", "deviation", "whitened"])

    return run


def whiten(spark: SparkSession, vectors: DataFrame, k: int, scale: float, offset: int, *, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component up to k.

    ``deviation`` is the sum over dimensions of (n * x - S)^2, null beyond a long.
    """
    blocks, dims = packed(spark, vectors, scale, offset, id_col, vector_col)
    found, kind = fit(blocks, dims, k, seed=seed), blocks.schema["ids"].dataType.elementType.simpleString()
    if not found or not len(found.deviations):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = blocks.mapInArrow(_whitened(found), f"vec_id {kind}, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in found.explained]), F.col("component"))
    return rows.select("vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(found.identity_error).alias("identity_error"))
