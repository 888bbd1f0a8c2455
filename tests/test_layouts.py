"""Clustered files, trees of tables, sketches."""

from __future__ import annotations

import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import sketches
from millrace.sources import schema, sinks


def groups_met(folder: str, column: str, low, high) -> tuple[int, int, int, int]:
    """Files and row groups in all, and those whose statistics meet [low, high]."""
    files = groups = met_files = met_groups = 0
    for path in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        at = meta.schema.names.index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        hits = sum(s.min <= high and s.max >= low for s in stats)
        files, groups, met_files, met_groups = files + 1, groups + len(stats), met_files + (hits > 0), met_groups + hits
    return files, groups, met_files, met_groups


def rows_read(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_clustering_prunes_by_every_column(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    lines = spark.range(20_000).select(F.col("id").alias("l_orderkey"), (F.xxhash64("id") % 1000).alias("l_partkey"), (F.xxhash64("id", F.lit(1)) % 1000).alias("l_suppkey")).unionByName(lines.drop("l_quantity"))
    plain, clustered = f"{tmp_path}/plain", f"{tmp_path}/clustered"
    lines.repartition(64).write.parquet(plain)
    sinks.write_clustered(lines, clustered, ["l_partkey", "l_suppkey"], 64, rows_a_group=100)
    assert sorted(spark.read.parquet(clustered).collect()) == sorted(lines.collect())
    for column in ("l_partkey", "l_suppkey"):
        _, _, unclustered, _ = groups_met(plain, column, 500, 510)
        files, groups, met, met_groups = groups_met(clustered, column, 500, 510)
        assert unclustered == files == 64 and met < unclustered / 4 and met_groups < groups / 8
        wanted = spark.read.parquet(clustered).filter(F.col(column).between(500, 510))
        assert 0 < rows_read(wanted) < lines.count() / 8
        assert wanted.count() == lines.filter(F.col(column).between(500, 510)).count()


def test_clustering_of_texts_times_and_nulls(spark, tmp_path):
    rows = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), F.hex(F.col("id") * 7919 % 300))).alias("name"), F.timestamp_seconds(F.col("id") * 86_400).cast("timestamp_ntz").alias("at"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"), "id")
    sinks.write_clustered(rows, f"{tmp_path}/t", ["name", "at", "v", "id"], 4, bits=4)
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/t").collect())) == sorted(map(repr, rows.collect()))
    sinks.write_clustered(rows.limit(0), f"{tmp_path}/none", ["id"], 2)
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        sinks.write_clustered(rows, f"{tmp_path}/x", [], 2)


# --- trees of tables --------------------------------------------------------------------

NESTED = "id int, name string, items array<struct<sku:string,marks:array<int>>>, version int"


def as_documents(spark, paths):
    """The nested documents that the tables below ``paths`` stand for."""
    tables = {name: [r.asDict() for r in spark.read.parquet(path).collect()] for name, path in paths.items()}
    marks = {}
    for m in sorted(tables.get("docs__items__marks", []), key=lambda m: m["_dlt_list_idx"]):
        marks.setdefault(m["_dlt_parent_id"], []).append(m["value"])
    items = {}
    for i in sorted(tables.get("docs__items", []), key=lambda i: i["_dlt_list_idx"]):
        assert i["_dlt_root_id"] == i["_dlt_parent_id"]
        items.setdefault(i["_dlt_parent_id"], []).append((i["sku"], marks.pop(i["_dlt_id"], [])))
    assert not marks  # no mark without its item
    found = {d["id"]: (d["name"], items.pop(d["_dlt_id"], [])) for d in tables["docs"]}
    assert not items  # no item without its document
    return found


def test_merge_cascades_to_children_at_any_depth(spark, tmp_path):
    folder = f"file://{tmp_path}/tree"
    first = spark.createDataFrame([(1, "a", [("x", [1, 2]), ("y", [])], 0), (2, "b", [("z", [3])], 0), (3, "c", None, 0), (None, "n", [("q", [4])], 0)], NESTED)
    paths = sinks.merge_nested(folder, first, "docs", "l1", ["id"], order=["version"])
    whole = {1: ("a", [("x", [1, 2]), ("y", [])]), 2: ("b", [("z", [3])]), 3: ("c", []), None: ("n", [("q", [4])])}
    assert as_documents(spark, paths) == whole
    assert as_documents(spark, sinks.merge_nested(folder, first, "docs", "l1-again", ["id"], order=["version"])) == whole
    second = spark.createDataFrame([(1, "a2", [("x", [9])], 1), (1, "late", [("gone", [8, 8, 8])], 0), (2, "b2", [], 1), (4, "d", [("w", [5, 6])], 1), (None, "n2", None, 1)], NESTED)
    paths = sinks.merge_nested(folder, second, "docs", "l2", ["id"], order=["version"])
    assert as_documents(spark, paths) == {1: ("a2", [("x", [9])]), 2: ("b2", []), 3: ("c", []), 4: ("d", [("w", [5, 6])]), None: ("n2", [])}


def test_documents_without_a_list_still_lose_their_children(spark, tmp_path):
    folder = f"file://{tmp_path}/tree"
    sinks.merge_nested(folder, spark.createDataFrame([(1, "a", [("x", [1])], 0), (2, "b", [("y", [2])], 0)], NESTED), "docs", "l1", ["id"])
    paths = sinks.merge_nested(folder, spark.createDataFrame([(1, "flat", 1)], "id int, name string, more int"), "docs", "l2", ["id"])
    assert set(paths) == {"docs", "docs__items", "docs__items__marks"}
    assert as_documents(spark, paths) == {1: ("flat", []), 2: ("b", [("y", [2])])}
    assert {r.id: r.more for r in spark.read.parquet(paths["docs"]).collect()} == {1: 1, 2: None}


def test_children_of_lists_of_lists(spark):
    nested = spark.createDataFrame([(1, [[1, 2], [3]])], "id int, grid array<array<int>>")
    tables = schema.parent_and_children(nested, "t", "l", ["id"])
    assert list(tables) == ["t", "t__grid", "t__grid__value"]
    assert sorted(r.value for r in tables["t__grid__value"].collect()) == [1, 2, 3]


# --- sketches ---------------------------------------------------------------------------


def test_united_sketches_are_the_sketch_of_all_rows(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 10).alias("day"), F.when(F.col("id") % 11 > 0, F.xxhash64("id") % 8000).alias("v"))
    daily = sketches.distinct_sketches(rows, ["k", "day"], "v")
    united = {r.k: r.estimate for r in sketches.united_sketches(daily, ["k"]).collect()}
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert all(abs(united[k] - exact[k]) <= 4 * sketches.SKETCH_ERROR * exact[k] for k in exact)
    assert json.dumps(sorted(united)) == json.dumps(sorted(exact))
