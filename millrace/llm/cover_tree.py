"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to the nearest of up to ``PIVOTS`` sampled vectors, and within a
pivot to blocks of bounded size by a hash, so a block is a region of space and a
dense region is several blocks. A block is known by its pivot (the centre), its
covering radius and its longest vector. Each block of queries first meets the data
block with the best bound; that gives every query a k-th score, and then it meets
only the data blocks whose bound reaches the worst of these. For a pair of blocks
one task builds a cover tree over either side and walks both together: a pair of
nodes is skipped if no vector of the one can reach, with any query of the other,
that query group's worst k-th score. The bound comes from centres and covering
radii,

    <q, p> <= <cq, cp> + rq |cp| + rp |cq| + rq rp
    <q, p> <= (|q|max^2 + |p|max^2 - max(0, |cq - cp| - rq - rp)^2) / 2,

whichever is smaller. Leaves meet in one matrix product. A node whose points
keep so far apart that a cover would need a centre for nearly each of them stays a
leaf: its children could not be told apart by any bound. A window merges the
blocks' best k a query; it limits rows before its shuffle.

Vectors that occur many times are folded first: of equal vectors only the k + 1
smallest ids can be among anyone's k best (one of them may be the query), so the
others cannot change a result. Scores are exact: products stay below 2**46 in
double arithmetic, larger components are scored with Python integers.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; only vectors of equal length are compared;
empty vectors score zero among themselves; rows with equal id and vector count
once; a query is never its own candidate, by id; scores beyond 64 bits are
clipped; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hash128, reliable_checkpoint

DATA_BLOCK, QUERY_BLOCK, LEAF, BASE = 8192, 1024, 64, 1.6
PIVOTS = 256
FEW_CENTRES = 16  # after so many, a cover must hold a quarter of the points, or its node stays a leaf
CODE_BITS = 16  # room for a row's number in a block, at the low end of a sort key
COLUMNS = 2048  # of a leaf, scored at once
EXACT = 2**46
NONE = -(2**63)  # no k-th score yet


class CoverTree:
    """Nodes with a centre, a covering radius and either children or points.

    Children's centres cover their parent's points within the parent's radius
    divided by ``BASE``, lie farther apart than that, and include its centre.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt((x * x).sum(1))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.longest: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        if len(x):
            everything = np.arange(len(x))
            self._grow(everything, 0, self._distance(0, everything))

    def _distance(self, centre: int, points: np.ndarray) -> np.ndarray:
        difference = self.x[points] - self.x[centre]
        return np.sqrt(np.einsum("ij,ij->i", difference, difference))

    def _grow(self, points: np.ndarray, centre: int, distance: np.ndarray) -> int:
        todo: list[tuple[np.ndarray, int, np.ndarray, int]] = [(points, centre, distance, -1)]
        while todo:
            points, centre, distance, parent = todo.pop()
            node = len(self.centre)
            radius = float(distance.max())
            self.centre.append(centre)
            self.radius.append(radius)
            self.longest.append(float(self.norm[points].max()))
            self.children.append([])
            self.points.append(points)
            if parent >= 0:
                self.children[parent].append(node)
            if len(points) <= LEAF or radius == 0:
                continue
            reach, rest, far, children = radius / BASE, points, distance, []
            while len(rest):
                near = far <= reach
                children.append((rest[near], centre, far[near], node))
                rest = rest[~near]
                if len(children) == FEW_CENTRES and 4 * len(rest) > 3 * len(points):
                    children = []
                    break
                if len(rest):
                    centre = int(rest[0])
                    far = self._distance(centre, rest)
            todo += children
        return 0


def dual_tree_top_k(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Sort keys and scores of each query's best k; ``data_ids`` ascend. Also counts of the work done.

    Scores below a query's ``floor`` need not be found.
    """
    nothing = np.iinfo(np.int64).min
    best = np.full((len(queries), k), nothing, np.int64)
    least = np.full(len(queries), nothing, np.int64) if floor is None else floor << CODE_BITS
    code = (1 << CODE_BITS) - 1 - np.arange(len(data), dtype=np.int64)
    q, p = CoverTree(queries), CoverTree(data)
    work = {"leaf_pairs": 0, "pruned": 0}

    def bound(a: int, b: int) -> float:
        ca, cb = q.centre[a], p.centre[b]
        ra, rb, na, nb = q.radius[a], p.radius[b], q.norm[ca], p.norm[cb]
        dot = float(q.x[ca] @ p.x[cb])
        apart = max(0.0, np.sqrt(max(0.0, na * na + nb * nb - 2 * dot)) - ra - rb)
        return min(dot + ra * nb + rb * na + ra * rb, (q.longest[a] ** 2 + p.longest[b] ** 2 - apart * apart) / 2)

    todo = [(np.inf, 0, 0)] if len(queries) and len(data) else []
    while todo:
        most, a, b = todo.pop()
        rows = q.points[a]
        worst = int(np.maximum(best[rows, k - 1], least[rows]).min())
        if worst != nothing and most + 1e-6 * abs(most) + 1 < worst >> CODE_BITS:
            work["pruned"] += 1
            continue
        kids_a, kids_b = q.children[a], p.children[b]
        if not kids_a and not kids_b:
            work["leaf_pairs"] += 1
            for lo in range(0, len(p.points[b]), COLUMNS):
                cols = p.points[b][lo : lo + COLUMNS]
                keys = (np.rint(queries[rows] @ data[cols].T).astype(np.int64) << CODE_BITS) + code[cols]
                keys[(query_ids[rows][:, None] == data_ids[cols][None, :]) | (keys < least[rows][:, None])] = nothing
                both = np.concatenate([best[rows], keys], axis=1)
                if both.shape[1] > k:
                    both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                best[rows] = np.sort(both, axis=1)[:, ::-1]
        elif kids_b and (not kids_a or p.radius[b] >= q.radius[a]):
            todo += sorted((bound(a, c), a, c) for c in kids_b)
        else:
            todo += sorted((bound(c, b), c, b) for c in kids_a)
    return best, best >> CODE_BITS, work


def _block_top_k(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        left, right = left.sort_values("vec_id"), right.sort_values("vec_id", ignore_index=True)
        lids, rids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        a, b = (np.stack(x["q"].to_list()).reshape(len(x), -1) for x in (left, right))
        top = max(int(np.abs(a.astype(object)).max()) if a.size else 0, int(np.abs(b.astype(object)).max()) if b.size else 0)
        if top * top * max(1, a.shape[1]) < EXACT:
            parts, reach = [], 1 << CODE_BITS
            floor = np.clip(left["floor"].to_numpy(), -EXACT, EXACT)
            for lo in range(0, len(b), reach):
                own = rids[lo : lo + reach]
                best, scores, _ = dual_tree_top_k(a.astype(np.float64), lids, b[lo : lo + reach].astype(np.float64), own, k, floor)
                filled = best != np.iinfo(np.int64).min
                rows, _ = np.nonzero(filled)
                parts.append(pd.DataFrame({"query_id": lids[rows], "vec_id": own[reach - 1 - (best[filled] & (reach - 1))], "score": scores[filled]}))
            return pd.concat(parts)
        for i, v in enumerate(a.astype(object)):
            scored = sorted((-int(s), int(r)) for s, r in zip(b.astype(object) @ v, rids, strict=True) if r != lids[i])[:k]
            for s, r in scored:
                out["query_id"].append(int(lids[i]))
                out["vec_id"].append(r)
                out["score"].append(max(-(2**63), min(2**63 - 1, -s)))
    return pd.DataFrame(out).astype("int64")


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and q = floor(1024 * x), one row a usable row of ``vectors``."""
    usable = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("q"))


def _dealt(vectors: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """``vectors`` (vec_id, q, is_query) with dim, pivot (-1: none of that length), distance from it and norm."""
    by_length = {n: [i for i, p in enumerate(pivots) if len(p) == n] for n in {len(p) for p in pivots}}
    centres = {n: np.stack([pivots[i] for i in own]) for n, own in by_length.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            values, ends = lists.values.to_numpy().astype(float)[ends[0] : ends[-1]], ends - ends[0]
            size = np.diff(ends)
            pivot, distance, norm = np.full(len(size), -1, np.int64), np.zeros(len(size)), np.zeros(len(size))
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                x = values[ends[rows][:, None] + np.arange(n)]
                norm[rows] = np.sqrt((x * x).sum(1))
                if n in centres:
                    c = centres[n]
                    near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
                    pivot[rows] = np.array(by_length[n])[near]
                    distance[rows] = np.sqrt(((x - c[near]) ** 2).sum(1))
            more = (pa.array(size), pa.array(pivot), pa.array(distance), pa.array(norm))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["vec_id", "q", "is_query", "dim", "pivot", "distance", "norm"])

    return vectors.mapInArrow(nearest, "vec_id long, q array<long>, is_query boolean, dim long, pivot long, distance double, norm double")


def _in_blocks(dealt: DataFrame, size: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """``dealt`` with ``block``, about ``size`` rows each, and a row for each block: dim, pivot, block, radius, longest."""
    counts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) * 5 / (4 * size)).alias("blocks"))
    own = dealt.join(counts, ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col("blocks"))).drop("blocks")
    return own, own.groupBy("dim", "pivot", "block").agg(F.max("distance").alias("radius"), F.max("norm").alias("longest"))


def _bounded_pairs(queries: DataFrame, data: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """dim, qp, qb, dp, db and the bound on any score between a block of queries and a block of data."""
    spark = queries.sparkSession
    near = [(i, j, float(a @ b), float(np.sqrt(a @ a)), float(np.sqrt(b @ b))) for i, a in enumerate(pivots) for j, b in enumerate(pivots) if len(a) == len(b)]
    centres = spark.createDataFrame(near, "qp long, dp long, dot double, nq double, nd double")
    left = queries.select("dim", F.col("pivot").alias("qp"), F.col("block").alias("qb"), F.col("radius").alias("rq"), F.col("longest").alias("lq"))
    right = data.select("dim", F.col("pivot").alias("dp"), F.col("block").alias("db"), F.col("radius").alias("rd"), F.col("longest").alias("ld"))
    met = left.join(right, "dim").join(centres, ["qp", "dp"], "left")
    apart = F.greatest(F.lit(0.0), F.sqrt(F.greatest(F.lit(0.0), F.expr("nq * nq + nd * nd - 2 * dot"))) - F.expr("rq + rd"))
    bound = F.least(F.expr("dot + rq * nd + rd * nq + rq * rd"), (F.expr("lq * lq + ld * ld") - apart * apart) / 2)
    bound = F.coalesce(F.when(F.col("dot").isNotNull(), bound), F.expr("lq * ld"))
    return met.select("dim", "qp", "qb", "dp", "db", (bound + 1e-6 * F.abs(bound) + 1).alias("bound"))


def top_k(vectors: DataFrame, *, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, q) that ``is_query`` holds for."""
    vectors = reliable_checkpoint(vectors.dropDuplicates(["vec_id", "q"]).withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    n_pivots = min(PIVOTS, -(-vectors.count() // DATA_BLOCK))
    pivots = [np.array(r["q"], float) for r in vectors.select("q", F.xxhash64(F.lit(3), "q").alias("h")).distinct().orderBy("h", "q").limit(n_pivots).collect()]
    dealt = reliable_checkpoint(_dealt(vectors, pivots))
    h1, h2 = hash128(F.col("q"))
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    folded = dealt.withColumns({"h1": h1, "h2": h2}).withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("h1", "h2", "nth")
    queries, query_blocks = _in_blocks(dealt.filter("is_query"), QUERY_BLOCK, 1)
    data, data_blocks = _in_blocks(folded, DATA_BLOCK, 2)
    queries = queries.select("dim", F.col("pivot").alias("qp"), F.col("block").alias("qb"), "vec_id", "q")
    data = data.select("dim", F.col("pivot").alias("dp"), F.col("block").alias("db"), "vec_id", "q")
    pairs = reliable_checkpoint(_bounded_pairs(query_blocks, data_blocks, pivots))
    best_first = Window.partitionBy("dim", "qp", "qb").orderBy(F.desc("bound"), "dp", "db")
    pairs = pairs.withColumn("nth", F.row_number().over(best_first))
    key, order = ["dim", "qp", "qb", "dp", "db"], Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def met(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        left = pairs.select(*key).join(queries, ["dim", "qp", "qb"]).groupBy(*key)
        right = pairs.select(*key).join(data, ["dim", "dp", "db"]).select(*(F.col(c).alias(f"{c}_") for c in key), "vec_id", "q")
        return ranked(left.cogroup(right.groupBy(*(f"{c}_" for c in key))).applyInPandas(lambda a, b: _block_top_k(a, b, k), "query_id long, vec_id long, score long"))

    first = reliable_checkpoint(met(pairs.filter("nth = 1"), queries.withColumn("floor", F.lit(NONE))))
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    floored = reliable_checkpoint(queries.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("kth", F.lit(NONE))).drop("kth"))
    worst = floored.groupBy("dim", "qp", "qb").agg(F.min("floor").alias("worst"))
    rest = pairs.filter("nth > 1").join(worst, ["dim", "qp", "qb"]).filter((F.col("worst") == NONE) | (F.col("bound") >= F.col("worst")))
    return ranked(first.drop("rank").unionByName(met(rest, floored).drop("rank")))


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return top_k(quantized(table(spark, sf_dir, "embeddings")), is_query=F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
