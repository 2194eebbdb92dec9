"""Whitened embeddings: centred covariance summed on Spark, leading components by tridiagonalisation, bisection and inverse iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.store import ship_by_value, staged

ship_by_value(__name__)

EPS = float(np.finfo(float).eps)


def householder(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal ``q`` with ``v = q t q'``."""
    a, d = v.copy(), len(v)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_count(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each ``x``: negative pivots of its factors."""
    tiny = np.finfo(float).tiny / EPS
    pivot = diag[0] - x
    below = (pivot < 0).astype(int)
    for i in range(1, len(diag)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diag[i] - x - off[i - 1] ** 2 / pivot
        below += pivot < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection on the Sturm count."""
    reach = np.abs(diag) + np.r_[0, np.abs(off)] + np.r_[np.abs(off), 0]
    low, high = np.full(k, -reach.max()), np.full(k, reach.max())
    rank = len(diag) - 1 - np.arange(k)
    while True:
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            return high
        over = sturm_count(diag, off, mid) <= rank
        low, high = np.where(over, mid, low), np.where(over, high, mid)


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """``(t - shift) x = right`` by elimination with row exchanges; pivots are kept off zero."""
    d = len(diag)
    main, up, up2, down = diag - shift, np.r_[off, 0.0], np.zeros(d), off.copy()
    y = right.copy()
    for i in range(d - 1):
        if abs(down[i]) > abs(main[i]):
            main[i], down[i] = down[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(main[i]) < floor:
            main[i] = floor
        f = down[i] / main[i]
        main[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
        y[i + 1] -= f * y[i]
    if abs(main[-1]) < floor:
        main[-1] = floor
    for i in range(d - 1, -1, -1):
        y[i] -= (up[i] * y[i + 1] if i + 1 < d else 0.0) + (up2[i] * y[i + 2] if i + 2 < d else 0.0)
        y[i] /= main[i]
    return y


def leading_components(v: np.ndarray, k: int, close: float = 1e-3, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix and their unit eigenvectors as columns.

    Vectors of eigenvalues within ``close`` of each other (as a share of the norm) are made
    orthogonal to the earlier ones of their cluster in every step of the inverse iteration.
    """
    size = float(np.abs(v).max())
    if size == 0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    diag, off, q = householder(v / size)
    values = leading_values(diag, off, k)
    norm = max(float(np.abs(diag).max()), float(np.abs(off).max(initial=0)))
    rng, found, cluster = np.random.default_rng(0), [], 0
    for j in range(k):
        if j and values[j - 1] - values[j] > close * norm:
            cluster = j
        x = rng.standard_normal(len(diag))
        for step in range(rounds):
            x = solve_shifted(diag, off, values[j], x / np.linalg.norm(x), EPS * norm)
            for _ in range(2):
                for other in found[cluster:]:
                    x = x - other * (other @ x)
            x /= np.linalg.norm(x)
            rest = diag * x - values[j] * x
            rest[:-1] += off * x[1:]
            rest[1:] += off * x[:-1]
            if step and np.abs(rest).max() <= 4 * EPS * norm:
                break
        found.append(x)
    return values * size, q @ np.array(found).T


def rows_of(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summer(of, cells: int, slices: int):
    """A task that adds up ``of(rows)``, an array of ``cells`` numbers, over its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(0, b.num_rows, slices):
                got = of(b.slice(i, slices))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total.ravel())], names=["cell", "value"])

    return run


def total_over(df: DataFrame, of, cells: int, kind: str, slices: int = 1024) -> np.ndarray:
    """The sum of ``of`` over all rows: once per task, then by cell. ``cells`` numbers come to the driver."""
    parts = df.mapInArrow(summer(of, cells, slices), f"cell long, value {kind}")
    got = dict(parts.groupBy("cell").agg(F.sum("value").alias("value")).collect())
    return np.array([got[i] for i in range(cells)])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each vector and leading component.

    Entries become whole numbers ``floor(scale * c) + shift``; statistics are taken over the
    distinct vectors of these, so copies, also a third of all rows, weigh nothing. ``n`` and
    the sums per dimension are exact. The covariance is summed from centred rows, task by
    task and then cell by cell; the driver gets d x d numbers and finds the components.
    ``components`` x d numbers go back with the projection. The identity error
    is measured in another pass over the distinct vectors.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are vectors
    of another length than the most frequent one (the longer in a tie). Rows with a null or repeated
    id are kept. Components without variance (fewer distinct vectors than dimensions) have
    whitened 0 and no part in the identity error. No vectors give no rows. Other columns
    are ignored. A deviation above 2**63 raises an error.
    """
    c = F.col("v")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(c.isNotNull() & (F.size(c) > 0)).where(F.coalesce(finite, F.lit(False)))
    whole = staged(own.select("vec_id", F.transform(c, lambda e: F.floor(e * scale).cast("long") + shift).alias("x")), "lattice")
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    d = int(lengths[0]["d"])
    whole = whole.where(F.size("x") == d)
    fit = staged(whole.select("x").distinct(), "fit")

    n = fit.count()
    sums = total_over(fit, lambda b: rows_of(b, 0, d).sum(0), d, "long")

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    def gram(b: pa.RecordBatch) -> np.ndarray:
        y = centred(rows_of(b, 0, d))
        return (y.T @ y).ravel()

    cov = total_over(fit, gram, d * d, "double").reshape(d, d) / n
    cov = (cov + cov.T) / 2
    k, trace = min(components, d), float(np.trace(cov))
    values, basis = leading_components(cov, k)
    real = values > d * EPS * trace
    turn = basis * np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)
    explained = np.where(real, values, 0) / trace if trace > 0 else np.zeros(k)

    def spread(b: pa.RecordBatch) -> np.ndarray:
        w = centred(rows_of(b, 0, d)) @ turn
        return (w.T @ w).ravel()

    error = float(np.abs(total_over(fit, spread, k * k, "double").reshape(k, k) / n - np.diag(real.astype(float))).max(initial=0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = n * rows_of(b, 1, d) - sums
            if len(y) and float(np.abs(y).max()) ** 2 * d >= 2.0**62:
                far = [sum(int(e) ** 2 for e in row) for row in y]
            else:
                far = (y * y).sum(1)
            out = (y / n) @ turn
            m = len(y)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.column(0)).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(np.array(far, dtype=np.int64), k)),
                    pa.array(out.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whole.mapInArrow(project, schema)
