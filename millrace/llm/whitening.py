"""Embedding whitening by TSQR: principal directions without a covariance matrix.

Each distinct vector of integers counts once. Its sums per dimension are exact, and with
S = q n + r the centred row x - S / n is (x - q) - r / n, which rounds once. Every
partition reduces its centred rows to the R of a QR decomposition, a batch at a time; the
R factors are stacked and decomposed again along a reduction tree; the singular value
decomposition of the last R gives the directions (its right vectors) and the eigenvalues
(its squared singular values over n). The covariance is never formed, so its condition
number, the square of the data's, never enters.

*Scale.* Equal vectors are merged before the shuffle, so a vector in a third of all rows is
a row a map task. The distinct vectors are written once and read three times: for sums, R
factors and the check of the whitened covariance. What travels is a row of sums a batch, an
R of d x d a partition, merged in a tree, and a k x k matrix a batch, summed by grouping;
the driver gets d sums, one R and one k x k matrix, whatever the number of rows.

Defined results: vectors that are null or hold null or non-finite components give no rows,
nor do vectors of another dimension than the commonest, or with a component of 2**34 or
more; repeated rows and null ids are projected like others; directions have their largest
entry positive; where fewer directions than asked for have any variance (few distinct
vectors, constant or dependent dimensions) only those are returned, so a single distinct
vector gives no rows; ``deviation`` is null beyond 64 bits; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import reliable_checkpoint
from millrace.llm.vectors import integer_vectors, matrix, tree_depth

SCALE, OFFSET, LIMIT = 64, 1_000_000, 2**34
COMPONENTS = 16
NO_VARIANCE = 1e-12  # of the largest singular value: below, rounding is all there is


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums q n + r; right vectors (a column each), singular values, shares of the variance."""

    n: int
    quotient: np.ndarray
    remainder: tuple[int, ...]
    directions: np.ndarray
    singular: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient).astype(float) - np.array([r / self.n for r in self.remainder])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / self.singular * np.sqrt(self.n))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Squared distance of n x from the sums, exact."""
        near, rest = x - self.quotient, np.array(self.remainder, object)
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(x.shape[1], 1) < 2**63:
            off = near * self.n - rest.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        off = near.astype(object) * self.n - rest
        return [d if d < 2**63 else None for d in (off * off).sum(axis=1)]


def _upper(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _batch_sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "v": [matrix(batch, dim).sum(axis=0).tolist()]})


def _partition_r(batches: Iterator[pa.RecordBatch], dim: int, fit: Whitening) -> Iterator[pa.RecordBatch]:
    r = np.zeros((0, dim))
    for batch in batches:
        if batch.num_rows:
            r = _upper(np.vstack([r, fit.centred(matrix(batch, dim))]))
    if len(r):
        yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})


def _batch_moments(batches: Iterator[pa.RecordBatch], dim: int, fit: Whitening) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            w = fit.whitened(matrix(batch, dim))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "v": [[*w.sum(axis=0), *(w.T @ w).ravel()]]})


def _summed(parts: DataFrame, kind: str) -> tuple[int, list]:
    """The number of vectors and the sums by position of rows (n, v)."""
    total = parts.select("n", F.posexplode("v")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast(kind)).alias("s"))
    rows = sorted(total.collect())  # a row a position
    return (rows[0]["n"] if rows else 0), [r["s"] for r in rows]


def fit_whitening(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors ``x``, each row once; none where there is nothing to fit."""
    n, sums = _summed(distinct.mapInArrow(partial(_batch_sums, dim=dim), "n long, v array<long>"), "decimal(20,0)")
    if not n:
        return None
    exact = [divmod(int(s), n) for s in sums]
    centre = Whitening(n, np.array([q for q, _ in exact], np.int64), tuple(r for _, r in exact), np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    factors = distinct.mapInArrow(partial(_partition_r, dim=dim, fit=centre), "r binary").rdd
    r = factors.map(lambda row: np.frombuffer(row["r"]).reshape(-1, dim)).treeReduce(lambda a, b: _upper(np.vstack([a, b])), depth=tree_depth(factors.getNumPartitions()))
    _, singular, right = np.linalg.svd(r, full_matrices=False)
    kept = min(components, int((singular > singular[0] * NO_VARIANCE).sum()))
    if not kept:
        return None
    directions = right[:kept].T
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(kept)])
    return Whitening(n, centre.quotient, centre.remainder, directions, singular[:kept], (singular**2 / (singular**2).sum())[:kept])


def identity_error(distinct: DataFrame, dim: int, fit: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(fit.singular)
    n, values = _summed(distinct.mapInArrow(partial(_batch_moments, dim=dim, fit=fit), "n long, v array<double>"), "double")
    mean, second = np.array(values[:k]) / n, np.array(values[k:]).reshape(k, k) / n  # of rows that are centred already
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _projected(batches: Iterator[pa.RecordBatch], dim: int, fit: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(fit.singular)
    for batch in batches:
        x, m = matrix(batch, dim), batch.num_rows
        row = np.repeat(np.arange(m), k)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(pa.array(row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fit.n)),
                pa.array(fit.deviations(x), pa.int64()).take(pa.array(row)),
                pa.array(fit.whitened(x).ravel()),
                pa.array(np.tile(fit.explained, m)),
                pa.array(np.full(m * k, error)),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(rows: DataFrame, *, components: int = COMPONENTS, vector: str = "embedding", vec: str = "vec_id") -> DataFrame:
    """A row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    kept, dim = integer_vectors(rows.select(F.col(vec).cast("long").alias("vec_id"), F.col(vector).alias("v")), SCALE, OFFSET, LIMIT, vector="v", others=("vec_id",))
    if not dim:
        return spark.createDataFrame([], schema)
    distinct = reliable_checkpoint(kept.select("x").distinct())
    fit = fit_whitening(distinct, dim, components)
    if fit is None:
        return spark.createDataFrame([], schema)
    return kept.mapInArrow(partial(_projected, dim=dim, fit=fit, error=identity_error(distinct, dim, fit)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return whiten(table(spark, sf_dir, "embeddings"))
