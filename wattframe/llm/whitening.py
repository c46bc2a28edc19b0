"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi.

Each entry c becomes the whole number ``floor(64 * c) + 1000000``. The fit list is
each distinct vector of such numbers once, so copies weigh nothing. Tasks sum up
their part of the list (count, sums in whole numbers, products of entries
centred on the part's own mean), and parts are merged by the difference of their
means: no product of raw entries is ever summed.

The scatter matrix is factored as ``P L L' P'``, the largest diagonal first. Jacobi
rotations then make the columns of ``P L`` orthogonal, whose squared lengths are
the eigenvalues and whose directions are the components: the matrix itself is
never squared, so small eigenvalues keep their digits.

What reaches the driver is one matrix of the vectors' dimension from each of at
most ``GROUPS`` groups of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, stored

STEPS, OFFSET = 64, 1_000_000
#: Partial sums that reach the driver, at most.
GROUPS = 32
#: Eigenvalues below this share of all variance count as zero.
LEAST = 1e-12
#: Rows that are turned into a matrix at a time.
ROWS = 4096
_MOMENTS = "task int, n long, sums array<decimal(38,0)>, scatter binary"


def pivoted_cholesky(a: np.ndarray, least: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """``G`` (d by rank) with ``a = G G'`` and the order in which pivots were taken:
    rows of ``G`` in that order form a lower triangle. Stops when no diagonal
    entry is left above ``least`` of the trace."""
    rest, d = a.astype(float).copy(), len(a)
    order, g = np.arange(d), np.zeros((d, d))
    floor = least * max(float(np.trace(rest)), 0.0)
    for k in range(d):
        best = k + int(np.argmax(np.diag(rest)[order[k:]]))
        if rest[order[best], order[best]] <= floor:
            return g[:, :k], order
        order[[k, best]] = order[[best, k]]
        pivot, left = order[k], order[k:]
        g[left, k] = rest[left, pivot] / np.sqrt(rest[pivot, pivot])
        rest[np.ix_(left, left)] -= np.outer(g[left, k], g[left, k])
    return g, order


def one_sided_jacobi(g: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``g g'``, largest first, and unit eigenvectors as columns.

    Pairs of columns are rotated until all are orthogonal. In each of a sweep's
    steps every column is in one pair, so a step is a few matrix operations.
    """
    g = g.astype(float).copy()
    r = g.shape[1]
    seats = list(range(r + r % 2))
    tight = 1e-15 * max(r, 1) ** 0.5
    for _ in range(most_sweeps if r > 1 else 0):
        most = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = np.array([(min(p), max(p)) for p in zip(seats[:half], reversed(seats[half:])) if max(p) < r])
            i, j = pairs.T
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            most = max(most, float(off.max(initial=0.0)))
            turn = off > tight
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            sin = np.where(turn, cos * t, 0.0)
            g[:, i], g[:, j] = cos * x - sin * y, sin * x + cos * y
            # Everyone but the first moves on by one seat.
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if most <= tight:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    values = values[order]
    lengths = np.sqrt(values)
    return values, np.divide(g[:, order], lengths, out=np.zeros_like(g), where=lengths > 0)


@dataclass(frozen=True)
class Moments:
    """Count, exact sums less ``OFFSET`` each, and products of centred entries."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], scatter)


def moments_of(x: np.ndarray) -> Moments:
    """Of rows of whole numbers (or of doubles, whose sums are then left out)."""
    if x.dtype.kind == "i":
        sums = [int(s) for s in x.sum(0)] if not len(x) or np.abs(x).max() < 2**62 // len(x) else [sum(map(int, c)) for c in x.T]
        centre = np.array([s / max(len(x), 1) for s in sums])
    else:
        sums, centre = [0] * x.shape[1], x.mean(0) if len(x) else np.zeros(x.shape[1])
    rest = x - centre
    return Moments(len(x), sums, rest.T @ rest)


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and whole numbers less ``OFFSET`` of consecutive parts of a batch."""
    for k in range(0, batch.num_rows, ROWS):
        part = batch.column(column).slice(k, ROWS)
        yield k, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), d)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``y``, the whole numbers less ``OFFSET``, of the vectors whose entries
    are all finite. Entries of 2**50 and more do not count as finite."""
    v: Column = F.col("v").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(2**50))))
    return pick(vectors, id=id_col, v=vector_col).where(F.col("v").isNotNull()).where(F.coalesce(good, F.lit(False))).select(
        "id", F.transform(v, lambda c: F.floor(c * F.lit(float(STEPS))).cast("long")).alias("y")
    )


def _moments(fit: DataFrame, d: int, project: tuple[np.ndarray, np.ndarray] | None = None) -> Moments:
    """Moments of the column ``y`` of ``fit``, or of its projections ``(y - centre) @
    axes`` for ``project = (centre, axes)``."""
    size = d if project is None else project[1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments(0, [0] * size, np.zeros((size, size)))
        for batch in batches:
            for _, y in _matrix(batch, "y", d):
                total = total.merged(moments_of(y if project is None else (y - project[0]) @ project[1]))
        if total.n:
            yield row(TaskContext.get().partitionId() % GROUPS, total)

    def row(task: int, m: Moments) -> pa.RecordBatch:
        whole = pa.array([m.sums], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([m.n], pa.int64()), whole, pa.array([m.scatter.tobytes()], pa.binary())], ["task", "n", "sums", "scatter"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = merged(zip(pdf["n"], pdf["sums"], pdf["scatter"]))
        sums = [[pa.scalar(s, pa.decimal128(38, 0)).as_py() for s in total.sums]]
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "n": [total.n], "sums": sums, "scatter": [total.scatter.tobytes()]})

    def merged(rows) -> Moments:
        total = Moments(0, [0] * size, np.zeros((size, size)))
        for n, sums, scatter in rows:
            total = total.merged(Moments(int(n), [int(s) for s in sums], np.frombuffer(scatter, float).reshape(size, size)))
        return total

    parts = fit.select("y").mapInArrow(run, _MOMENTS).groupBy("task").applyInPandas(merge, _MOMENTS)
    # At most GROUPS rows of one matrix each, in the order of their groups.
    return merged((r["n"], r["sums"], r["scatter"]) for r in parts.orderBy("task").collect())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component`` (from 1), ``n`` (size
    of the fit list), ``deviation`` (sum over dimensions of ``(n * x - S)^2``, exact),
    ``whitened`` (``x - S / n`` on the component, over the root of its eigenvalue),
    ``explained`` (the eigenvalue's share of the trace) and ``identity_error``
    (largest entry of the whitened fit list's covariance less the identity).

    Left out are vectors that are null or hold null or non-finite entries, and
    those of another length than most of the fit list has (of equally frequent
    lengths the largest counts; vectors without entries are of none). Repeated
    rows stay, each with its components, and count once in the fit list. There are
    as many components as have an eigenvalue above ``LEAST`` of the trace: none,
    and no rows, if all vectors are the same or the table is empty. A deviation
    beyond the range of long is an error.
    """
    rows = whole_vectors(vectors, id_col, vector_col)
    every = stored(rows.select("y").distinct(), "fit-list")
    lengths = every.groupBy(F.size("y").alias("d")).agg(F.count("*").alias("n")).where("d > 0")
    most = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = rows.select(
        F.col("id").alias("vec_id"), F.lit(0).alias("component"), *(F.lit(0).cast("long").alias(c) for c in ("n", "deviation")), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error"))
    ).schema
    if not most:
        return vectors.sparkSession.createDataFrame([], schema)
    d = most[0]["d"]
    fit = every.where(F.size("y") == d)
    whole = _moments(fit, d)
    covariance = whole.scatter / whole.n
    values, axes = one_sided_jacobi(pivoted_cholesky(covariance)[0])
    trace = float(np.trace(covariance))
    kept = min(components, int((values > LEAST * trace).sum())) if trace > 0 else 0
    values, axes = values[:kept], axes[:, :kept]
    n, sums = whole.n, whole.sums
    centre = np.array([s / n for s in sums])
    scaled = axes / np.sqrt(values)
    again = _moments(fit, d, (centre, scaled))
    error = float(np.abs(again.scatter / n - np.eye(kept)).max(initial=0.0))
    explained = values / trace if kept else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_sum = max(map(abs, sums))
        for batch in batches:
            for k, y in _matrix(batch, "y", d):
                wide = float(np.abs(y).max(initial=0)) * n + most_sum
                # Exact in 64 bits where the squares fit, else in whole numbers of any size.
                if wide * wide * d < 2**62:
                    deviation = ((n * y - np.array(sums, np.int64)) ** 2).sum(1)
                else:
                    deviation = ((y.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
                white = (y - centre) @ scaled
                count = len(y) * kept
                ids = batch.column("id").slice(k, len(y)).take(pa.array(np.repeat(np.arange(len(y)), kept)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(y))),
                        pa.array(np.full(count, n), pa.int64()),
                        pa.array(np.repeat(deviation, kept).tolist(), pa.int64()),
                        pa.array(white.ravel()),
                        pa.array(np.tile(explained, len(y))),
                        pa.array(np.full(count, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.size("y") == d).mapInArrow(run, schema)
