"""Vector code compression: product codes from codebooks refined by integer rounds.

Vectors of integers are cut into ``PARTS`` parts. Each part position has a codebook whose
entries start as that part of the vectors with the smallest ids. A round assigns every part
to its nearest entry and moves each entry to the floor of its parts' mean; unused entries
stay. Everything is integer arithmetic, so results do not depend on task order.

*Plan.* Batches become columnar NumPy blocks (part, dimension, row). A round is one
treeAggregate over the RDD of these blocks: in a block, distances to all entries
accumulate dimension by dimension, and np.add.at adds rows into a tensor of sums (part,
entry, dimension) and one of counts; tensors are added along the reduction tree. The driver
gets one pair of tensors a round, and a broadcast takes the codebooks back: both have the
size of the codebooks, which the dimension fixes. Blocks come from the table anew in each
round, so a lost executor costs its tasks and nothing else. Errors per label are summed
before they are shuffled; the sums are broadcast if a count shows that they are few, else
joined, with a frequent label split by adaptive execution.

Defined results: vectors that are null or hold null or non-finite components give no rows,
nor do vectors of another dimension than the commonest, or with a component of 2**16 or
more; a dimension that PARTS does not divide is filled up with zeros; of rows that share one
of the first ids the smallest vector starts an entry; null ids are one id, the last; with
fewer ids than entries the codebook is smaller; ties go to the smaller entry; repeated rows
count as often as they occur; null labels are one label; a sum beyond 64 bits is null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import reliable_checkpoint
from millrace.llm.vectors import integer_vectors, matrix, tree_depth

SCALE, LIMIT = 256, 2**16
PARTS, ENTRIES, ROUNDS = 16, 64, 2
BROADCAST_LABELS = 10_000

Tensors = tuple[np.ndarray, np.ndarray]


def part_block(x: np.ndarray) -> np.ndarray:
    """Rows of integers as a block (part, dimension, row)."""
    filled = np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))
    return np.ascontiguousarray(filled.T.reshape(PARTS, -1, len(x)))


def nearest(part: np.ndarray, book: np.ndarray) -> Tensors:
    """For each column of ``part`` (dimension, row) the nearest entry of ``book`` (entry, dimension) and its squared distance."""
    distance = np.zeros((len(book), part.shape[1]), np.int64)
    for values, entries in zip(part, book.T, strict=True):
        off = values - entries[:, None]
        distance += off * off
    code = distance.argmin(axis=0)
    return code, distance[code, np.arange(part.shape[1])]


def _add_block(found: Tensors | None, block: np.ndarray, books: np.ndarray) -> Tensors:
    sums, counts = found if found is not None else (np.zeros_like(books), np.zeros(books.shape[:2], np.int64))
    for part, book, part_sums, part_counts in zip(block, books, sums, counts, strict=True):
        code, _ = nearest(part, book)
        np.add.at(part_sums, code, part.T)
        np.add.at(part_counts, code, 1)
    return sums, counts


def _add_tensors(a: Tensors | None, b: Tensors | None) -> Tensors | None:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _first_books(kept: DataFrame) -> np.ndarray:
    """(part, entry, dimension) of the vectors with the smallest ids."""
    ids = [r["vec_id"] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        chosen = chosen | F.col("vec_id").isNull()
    first = kept.filter(chosen).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(F.asc_nulls_last("vec_id")).collect()  # a row an entry
    return part_block(np.array([r["x"] for r in first], np.int64)).transpose(0, 2, 1).copy()


def refined_books(kept: DataFrame, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, dimension) after ``rounds`` rounds over all vectors ``x``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "block": [part_block(matrix(batch, dim)).tobytes()]})

    books = _first_books(kept)
    columns = kept.select("x").mapInArrow(blocks, "rows long, block binary").rdd.map(lambda r: np.frombuffer(r["block"], np.int64).reshape(PARTS, -1, r["rows"]))
    context, depth = kept.sparkSession.sparkContext, tree_depth(columns.getNumPartitions())
    for _ in range(rounds):
        sent = context.broadcast(books)
        sums, counts = columns.treeAggregate(None, lambda found, block, sent=sent: _add_block(found, block, sent.value), _add_tensors, depth=depth)
        sent.destroy()
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(kept: DataFrame, dim: int, books: Broadcast) -> DataFrame:
    """vec_id, label, code (an entry a part, in hex) and error (squared distance) of every vector."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, error, chosen = part_block(matrix(batch, dim)), np.zeros(batch.num_rows, np.int64), []
            for part, book in zip(block, books.value, strict=True):
                code, distance = nearest(part, book)
                chosen.append(code.astype(np.uint8))
                error += distance
            digits = np.stack(chosen, axis=1).tobytes().hex()
            texts = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(codes, f"vec_id long, label {label}, code string, error long")


def compress(rows: DataFrame, *, vector: str = "embedding", vec: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector."""
    columns = rows.select(F.col(vec).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kept, dim = integer_vectors(columns, SCALE, 0, LIMIT, vector="v", others=("vec_id", "label"))
    if not dim:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = refined_books(kept, dim)
    done = reliable_checkpoint(coded(kept, dim, rows.sparkSession.sparkContext.broadcast(books)))
    totals = reliable_checkpoint(done.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    few = totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    joined = done.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return compress(table(spark, sf_dir, "embeddings"))


def _round_sql(n: int) -> str:
    return f"""
d{n} AS (SELECT p.vec_id, p.part, c.entry,
           list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
         FROM parts p JOIN c{n} c USING (part)),
a{n} AS (SELECT vec_id, part, entry, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) AS nth FROM d{n}) WHERE nth = 1),
m{n} AS (SELECT part, entry, pos, floor(sum(p.v[pos])::DOUBLE / count(*))::BIGINT AS mean
         FROM a{n} JOIN parts p USING (vec_id, part), (SELECT unnest(range(1, w + 1)) AS pos FROM width) GROUP BY part, entry, pos),
c{n + 1} AS (SELECT c.part, c.entry, coalesce(any_value(m.v), any_value(c.v)) AS v
         FROM c{n} c LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS v FROM m{n} GROUP BY part, entry) m USING (part, entry) GROUP BY c.part, c.entry),"""


ORACLE = (
    """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(x)) // 16 AS w FROM kept),
parts AS (SELECT vec_id, part, x[part * w + 1 : part * w + w] AS v FROM kept, width, (SELECT unnest(range(16)) AS part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, entry, v FROM parts JOIN firsts USING (vec_id)),"""
    + "".join(map(_round_sql, range(ROUNDS)))
    + f"""
dz AS (SELECT p.vec_id, p.part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
       FROM parts p JOIN c{ROUNDS} c USING (part)),
az AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) AS nth FROM dz) WHERE nth = 1),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM az GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""
)
