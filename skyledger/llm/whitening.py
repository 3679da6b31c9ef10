"""Embedding whitening: pivoted Cholesky, then one-sided Jacobi on the factor.

Rows whose vector is null, or holds null or non-finite entries, are dropped.
Each entry ``c``, as a double, becomes the integer ``x = floor(64 c) + 1000000``.
Two passes sum exactly, in integers of any size: the vectors' number ``n`` and
sums ``S``; then, with the rounded means taken off before anything is
multiplied, the scatter, corrected for the rounding.  ``n^2 V`` of the
covariance ``V`` (divisor ``n``) is thereby an exact integer matrix, whatever
the order in which tasks end.

Its pivoted Cholesky factor ``L`` (largest remaining diagonal entry first, up to
the numerical rank) has ``V = L L^T``.  One-sided Jacobi rotates the columns of
``L`` until all are orthogonal: then their squared norms are the eigenvalues and
the normalised columns the eigenvectors, by falling eigenvalue, each with its
largest entry positive.  The driver holds matrices of the dimension only.

Further passes measure the covariance of the whitened vectors and write them.
Nothing but partial sums is shuffled.

Defined results: entries beyond ``LARGEST`` in magnitude count as non-finite;
the dimension is the commonest length of the remaining vectors (the greater one
of equals), others are dropped, empty ones too; components with no variance
beyond rounding have no rows; equal eigenvalues keep the order of the factor's
columns; a ``deviation`` beyond a long is null; repeated and null vec_ids are
rows of their own; an empty table, or one with equal vectors only, gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import slices, table
from skyledger.llm.sums import summed

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LARGEST = 1e100
#: Vectors handled at a time.
ROWS = 2048


@dataclass
class Whitening:
    """``n``, exact sums, eigenvalues (falling), components (columns), the trace
    of the covariance and the largest entry of (whitened covariance - identity)."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0


def usable(rows: DataFrame, column: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows with finite entries only."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda e: e.isNotNull() & (F.abs(e) <= LARGEST))  # NaN is greater than any number
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("vector")).filter(F.coalesce(finite, F.lit(False)) & (F.size("vector") > 0))


def _wide(x: np.ndarray) -> np.ndarray:
    """The integers ``floor(64 c) + 1000000`` where some do not fit a long."""
    out = np.empty(x.shape, object)
    out.flat = [SHIFT + (SCALE * int(c) if abs(c) >= 2.0 ** 53 else int(np.floor(SCALE * c))) for c in x.ravel().tolist()]
    return out


def vectors(batches, dim: int):
    """(ids, integer vectors) of each slice; int64 if they are small, else Python integers."""
    for part in slices(batches, ROWS):
        column = part.column(1)
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        yield part.column(0), (np.floor(SCALE * x).astype(np.int64) + SHIFT if np.abs(x).max(initial=0) < 2.0 ** 40 else _wide(x))


def _dump(a) -> bytes:
    return json.dumps([int(v) for v in a]).encode()


def _load(data: bytes) -> np.ndarray:
    return np.array([int(v) for v in json.loads(data)], object)


def _exact(x: np.ndarray) -> np.ndarray:
    """The sum of ``d d^T`` over the rows of an integer array, in Python integers."""
    most = max(int(x.max()), -int(x.min()))
    if x.dtype != object and most ** 2 * len(x) < 2 ** 53:
        d = x.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    d = x.astype(object)
    return d.T @ d


def first_moments(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums."""
    def partial(batches):
        total = None
        for _, x in vectors(batches, dim):
            if len(x):
                own = np.array([len(x), *x.sum(axis=0).tolist()], object)
                total = own if total is None else total + own
        return total

    total = summed(rows, partial, np.add, _dump, _load)
    return (0, [0] * dim) if total is None else (int(total[0]), [int(v) for v in total[1:]])


def scatter(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """``n^2`` times the covariance, exact (Python integers)."""
    dim = len(sums)
    near = [(2 * s + n) // (2 * n) for s in sums]  # rounded means
    left = np.array([s - n * m for s, m in zip(sums, near)], object)
    upper = np.triu_indices(dim)
    small = max(map(abs, near)) < 2 ** 50

    def partial(batches):
        total = None
        for _, x in vectors(batches, dim):
            if len(x):
                centred = x - np.array(near, np.int64) if small and x.dtype != object else x.astype(object) - np.array(near, object)
                own = _exact(centred)[upper]
                total = own if total is None else total + own
        return total

    flat = summed(rows, partial, np.add, _dump, _load)
    full = np.empty((dim, dim), object)
    full[upper] = flat
    full.T[upper] = flat
    return n * full - np.outer(left, left)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` with ``a = L L^T``: rows in the order of ``a``, one column for each
    pivot, up to the numerical rank."""
    dim = len(a)
    left = np.diag(a).copy()
    factor = np.zeros((dim, dim))
    done = np.zeros(dim, bool)
    least = dim * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(dim):
        pivot = int(np.argmax(np.where(done, -np.inf, left)))
        if not left[pivot] > least:
            return factor[:, :k]
        column = (a[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        column[done] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        factor[:, k] = column
        done[pivot] = True
        left -= column ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and directions of the factor's columns, rotated
    until each pair is orthogonal.  A sweep meets every pair once, in rounds of
    disjoint pairs that are rotated together."""
    a = factor.copy()
    rank = a.shape[1]
    size = rank + rank % 2
    ring = list(range(size))
    close = 4 * np.finfo(float).eps
    for _ in range(sweeps if rank > 1 else 0):
        turned = False
        for _ in range(size - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[:size // 2], reversed(ring[size // 2:])) if max(p, q) < rank]
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > close * np.sqrt(xx * yy)
            if turn.any():
                turned = True
                zeta = (yy - xx)[turn] / (2 * xy[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                x, y = x[:, turn], y[:, turn]
                a[:, p[turn]], a[:, q[turn]] = c * x - s * y, s * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    a, norms = a[:, order], norms[order]
    directions = a / norms
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(rank)]) if rank else np.ones(0)
    return norms ** 2, directions * signs


def _whitened(x: np.ndarray, model: Whitening, count: int) -> np.ndarray:
    return _centred(x, model) @ (model.components[:, :count] / np.sqrt(model.values[:count]))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """``x - S/n``: the whole part of the mean is taken off in integers."""
    whole, rest = np.array([s // model.n for s in model.sums], object), np.array([(s % model.n) / model.n for s in model.sums])
    if x.dtype != object and max(map(abs, whole)) < 2 ** 62:
        return (x - whole.astype(np.int64)) - rest
    return (x.astype(object) - whole).astype(np.float64) - rest


def dimension(rows: DataFrame) -> int:
    """The commonest length of the vectors (the greater one of equals); 0: none."""
    found = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return found.dim if found else 0


def fit(rows: DataFrame, dim: int, count: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``usable`` rows of one dimension; None without variance."""
    n, sums = first_moments(rows, dim)
    if not n:
        return None
    exact = scatter(rows, n, sums)
    covariance = np.array([[v / n ** 2 for v in row] for row in exact.tolist()], np.float64)  # integers: each rounded once
    values, components = one_sided_jacobi(pivoted_cholesky(covariance))
    if not len(values):
        return None
    model = Whitening(n, sums, values, components, sum(int(exact[i, i]) for i in range(dim)) / n ** 2)
    count = min(count, len(values))

    def partial(batches):
        total = np.zeros((count, count))
        for _, x in vectors(batches, dim):
            z = _whitened(x, model, count)
            total += z.T @ z
        return total

    total = summed(rows, partial, np.add, lambda a: a.tobytes(), lambda b: np.frombuffer(b).reshape(count, count))
    model.identity_error = float(np.abs(total / n - np.eye(count)).max())
    return model


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums over dimensions of ``(n x - S)^2``, exact; None beyond a long."""
    sums = np.array(model.sums, object)
    if x.dtype != object and model.n * int(np.abs(x).max(initial=0)) < 2 ** 62 and max(map(abs, model.sums)) < 2 ** 62:
        d = model.n * x - sums.astype(np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2 ** 63:
            return (d * d).sum(axis=1).tolist()
    d = model.n * x.astype(object) - sums
    return [v if v < 2 ** 63 else None for v in (d * d).sum(axis=1).tolist()]


def whitened(rows: DataFrame, dim: int, model: Whitening, count: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``deviation`` and ``whitened`` (array, one entry for each component) of every row."""
    count = min(count, len(model.values))

    def run(batches):
        for ids, x in vectors(batches, dim):
            z = np.ascontiguousarray(_whitened(x, model, count))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, count), pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(x, model), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings``, one row for each of its first 32 components."""
    rows = usable(table(spark, sf_dir, "embeddings"), "embedding")
    dim = dimension(rows)
    rows = rows.filter(F.size("vector") == dim)
    model = fit(rows, dim) if dim else None
    if model is None:
        return spark.createDataFrame([], OUT)
    explained = F.array(*[F.lit(float(v) / model.trace) for v in model.values[:COMPONENTS]])
    each = whitened(rows, dim, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, "at").alias("explained"), F.lit(model.identity_error).alias("identity_error"))
