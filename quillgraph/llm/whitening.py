"""Embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers (``floor(scale * c) + shift``), so that equal vectors,
their number and the sums per dimension are exact.  The components are fitted on
each distinct vector once.  One Spark pass takes a block Q of orthonormal columns to
``X'(XQ) / n`` on centred rows: a task multiplies its batches and sends one row for
each dimension, which Spark adds up; the covariance matrix itself is never formed
by the tasks nor held anywhere.  On the driver, where there are only matrices of
dimensions x block, the Rayleigh-Ritz step turns Q to Ritz vectors and values, the
residuals ``||Vq - eq||`` are taken, and the QR decomposition of the product is the
next Q.  The passes end when the residuals of all k components are within
``tolerance`` of the largest value, or no longer fall because rounding is all that is
left of them; after ``rounds`` passes without that it is an error.

A pass reads all vectors, so few passes matter more than narrow blocks: a block has
4k columns unless given, and as many as there are dimensions where those are fewer
(then one pass is enough).  A component converges by the ratio of the first value
beyond the block to its own.

Rows whose vector is null or holds a null or non-finite entry are left out.  So are
vectors of another length than most distinct ones have (of two lengths that are as
frequent, the longer stays).  Null and repeated ids stay as they are.  Components
whose value is within rounding of 0 (1e-12 of the trace) do not exist: fewer come
back, none for a single distinct vector, and no rows for an empty table.  A deviation
beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, small_batches

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``components`` has a column for each, ``values`` falls."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def on_grid(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """The vector as whole numbers; null where it must be left out."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda c: (F.floor(c * scale) + shift).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sums per dimension."""

    def run(batches):
        total, n = np.zeros(d, np.int64), 0
        for b in batches:
            x = _matrix(b.column(0), d)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(np.append(total, n))], ["i", "s"])

    found = dict(fit.select("x").mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum("s")).collect())
    return int(found.get(d, 0)), np.array([found.get(i, 0) for i in range(d)], np.int64)


def _product(fit: DataFrame, n: int, sums: np.ndarray, right: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """One pass: ``L'X'(XR) / n`` on centred rows (L: unit matrix unless given), and the trace of the covariance."""
    d, b = right.shape
    rows = d if left is None else left.shape[1]
    names = [f"c{j}" for j in range(b)]

    def run(batches):
        total, squares = np.zeros((rows, b)), 0.0
        for batch in batches:
            x = (n * _matrix(batch.column(0), d) - sums) / n
            total += (x if left is None else x @ left).T @ (x @ right)
            squares += float(np.einsum("ij,ij->", x, x))
        total = np.vstack([total, np.full((1, b), squares)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows + 1)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], ["i", *names])

    out = fit.select("x").mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names))
    found = {r["i"]: r[1:] for r in out.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    return np.array([found[i] for i in range(rows)]) / n, found[rows][0] / n


def fit_whitening(fit: DataFrame, d: int, k: int = 16, block: int | None = None, tolerance: float = 1e-13, rounds: int = 300, seed: int = 12) -> Whitening:
    """The k leading components of the vectors ``x`` of d dimensions, each row counted."""
    n, sums = _sums(fit, d)
    k = min(k, d)
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    if n < 2 or not k:
        return none
    b = min(d, max(k, block or 4 * k))
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))
    before = float("inf")
    for passes in range(1, rounds + 1):
        y, trace = _product(fit, n, sums, q)
        if trace <= 0:
            return none
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, y = q @ turn, y @ turn
        worst = float(np.linalg.norm(y[:, :k] - ritz[:, :k] * values[:k], axis=0).max() / values[0])
        if worst <= tolerance or worst <= 1e-11 and worst > before / 2:
            break
        before = worst
        q, _ = np.linalg.qr(y)
    else:
        raise ValueError(f"{rounds} passes left a residual of {worst:.1e}; take a wider block than {b}")
    there = values[:k] > 1e-12 * trace
    c, values = ritz[:, :k][:, there], values[:k][there]
    c = c * np.where(c[np.abs(c).argmax(axis=0), np.arange(c.shape[1])] < 0, -1.0, 1.0)
    w = c / np.sqrt(values)
    covariance, _ = _product(fit, n, sums, w, w)
    return Whitening(n, sums, c, values, trace, float(np.abs(covariance - np.eye(len(values))).max()), passes)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sums of (n x - S)^2, exactly; None beyond a long."""
    a = n * x - sums
    if not a.size or int(np.abs(a).max()) ** 2 * a.shape[1] < 1 << 63:
        return (a * a).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in a)]


def whiten(spark: SparkSession, frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, block: int | None = None, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: its whitened coordinate, with what holds for the vector, the component and the fit."""
    work = Workspace(spark, "whitening")
    rows = frame.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), on_grid(F.col(f"`{vector_col}`"), scale, shift).alias("x")).where("x is not null")
    distinct = work.table(rows.select("x").distinct(), "distinct")
    length = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length["d"] if length else 0
    if not d:
        work.drop()
        return spark.createDataFrame([], OUT)
    with small_batches(spark):
        fitted = fit_whitening(distinct.where(F.size("x") == d), d, k, block)
        work.drop()
        if not len(fitted.values):
            return spark.createDataFrame([], OUT)
        n, sums, w = fitted.n, fitted.sums, fitted.components / np.sqrt(fitted.values)

        def run(batches):
            for b in batches:
                x = _matrix(b.column(1), d)
                y = ((n * x - sums) / n) @ w
                offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], ["vec_id", "deviation", "y"])

        explained = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values])
        found = rows.where(F.size("x") == d).mapInArrow(run, "vec_id long, deviation long, y array<double>")
        each = found.select("vec_id", "deviation", F.posexplode("y").alias("j", "whitened"))
        out = each.select("vec_id", (F.col("j") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("j")].alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))
        return out
