"""Embeddings as exact integers, shared by whitening and code compression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name


def integer_vectors(rows: DataFrame, scale: int, offset: int, limit: int, *, vector: str = "embedding", others: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``others`` and ``x``: floor(scale * component) + offset, as longs; and the dimension.

    Vectors that are null or hold null or non-finite components, or one of ``limit`` or more, are left
    out, and so are those whose dimension is not the commonest (of equally common ones the largest).
    """
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < limit))
    x = free_name(rows.select(*others), "x")
    whole = rows.filter(F.col(vector).isNotNull() & finite)
    sizes = whole.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    integers = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    return whole.filter(F.size(vector) == dim).select(*others, integers.alias(x)), dim


def matrix(batch: pa.RecordBatch, dim: int, column: str = "x") -> np.ndarray:
    """The vectors of a batch, a row each."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tree_depth(partitions: int, fan: int = 16) -> int:
    """Levels of a reduction tree in which no node gets many more than ``fan`` inputs."""
    return max(2, int(np.ceil(np.log(max(partitions, 2)) / np.log(fan))))
