"""Line dedup over overlapping three-line windows.

Every run of three consecutive lines is a window, known by a 128-bit hash of its
lines. The first place of each window in (doc_id, position) order stays; all
lines that any later occurrence covers are removed, overlapping windows merged.

Plan: one aggregation finds each repeated window's first place (partial sums
before the shuffle, so a passage in a third of all documents arrives as a row a
map task); the windows are joined with the repeated ones only (a sort-merge join
whose hot side adaptive execution splits); covered positions are gathered per
document, a size that the document bounds, and one join brings them back.

Defined results: null text has no lines and counts as empty; documents of fewer
than three lines are unchanged; rows with equal doc_id and text are one document
(all of them get its result), rows with equal doc_id and different texts are
told apart by text; null doc_ids come first; a window that overlaps its own
earlier occurrence counts like any other; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_names, hash128

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(keyed: DataFrame, doc: str, mark: str) -> DataFrame:
    hashed = keyed.select(
        F.col(doc).alias("d"),
        F.col(mark).alias("m"),
        F.transform(lines_of(F.col("text")), lambda line: F.struct(*(h.alias(n) for h, n in zip(hash128(line), "ab", strict=True)))).alias("h"),
    ).filter(F.size("h") >= WINDOW)

    def at(i: Column) -> Column:
        around = [F.get(F.col("h"), i + k) for k in range(WINDOW)]
        return F.struct(i.alias("p"), F.xxhash64(*(x["a"] for x in around)).alias("w1"), F.xxhash64(*(x["b"] for x in around)).alias("w2"))

    return hashed.select("d", "m", F.inline_outer(F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), at)))


def covered_lines(docs: DataFrame, doc: str, mark: str) -> DataFrame:
    """d, m and the sorted line positions that later occurrences cover."""
    windows = _windows(docs, doc, mark)
    place = F.struct("d", "m", "p")
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(repeated, ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("d", "m").agg(F.collect_set("p").alias("starts")).select("d", "m", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*(p + k for k in range(WINDOW)))))).alias("covered"))


def dedup_lines(docs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` stripped of repeated windows, plus n_lines and n_removed."""
    mark, rows, gone, d, m, covered = free_names(docs, "text_mark", "n_lines", "n_removed", "d", "m", "covered")
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    hit = covered_lines(keyed, doc, mark).toDF(d, m, covered)
    out = keyed.join(hit, F.col(doc).eqNullSafe(F.col(d)) & (F.col(mark) == F.col(m)), "left")
    lines = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    text = F.when(F.col(covered).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(F.col(covered).isNull(), 0).otherwise(F.size(F.col(covered)))
    return out.withColumns({rows: F.size(lines).cast("long"), gone: removed.cast("long"), "text": text}).drop(mark, d, m, covered)


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, p, ls[p+1] AS a, ls[p+2] AS b, ls[p+3] AS c
      FROM (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) AS p FROM d)),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS nth FROM w),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM
      (SELECT doc_id, unnest([p, p+1, p+2]) AS q FROM k WHERE nth > 1) GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN array_to_string(ls, chr(10))
       ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i+1]), chr(10)), '') END AS text
FROM d LEFT JOIN g USING (doc_id)"""
