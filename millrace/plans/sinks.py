"""Sinks: write, run again, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import row_id
from millrace.operators import relational as R
from millrace.registry import Tables, query
from millrace.session import shared_folder
from millrace.sources.sinks import evaluated_once, insert_through_staging, merge_into, merge_nested, monthly, write_clustered, write_parquet


@query("snk_1_overwrite", "SNK-1", "SNK-3", sql="SELECT n_nationkey, n_name FROM nation")
def overwrite(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "sink")
    for _ in range(2):
        write_parquet(t.nation.select("n_nationkey", "n_name"), folder, files=2)
    return t.spark.read.parquet(folder)


@query("snk_2_dynamic_partitions", "SNK-2", "SNK-15", sql="SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN year(o_orderdate) = 1996 THEN 'new' ELSE 'old' END AS version FROM orders")
def dynamic_partitions(t: Tables) -> DataFrame:
    """The second write replaces one partition and leaves the others."""
    folder = shared_folder(t.spark, "sink")
    keyed = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    write_parquet(keyed.withColumn("version", F.lit("old")), folder, partitions=["year"], sort=["o_orderkey"])
    write_parquet(keyed.filter("year = 1996").withColumn("version", F.lit("new")), folder, partitions=["year"], sort=["o_orderkey"])
    return t.spark.read.parquet(folder).select("o_orderkey", "year", "version")


@query("snk_4_insert_only", "SNK-4", "SNK-6", "SNK-12", sql="SELECT o_orderkey, md5(concat(o_orderkey::VARCHAR, coalesce(o_orderstatus, ''))) AS unique_row_id FROM orders")
def insert_only(t: Tables) -> DataFrame:
    """Loading an overlapping set twice leaves each row once."""
    folder = shared_folder(t.spark, "sink")
    rows = t.orders.select("o_orderkey", row_id("o_orderkey", "o_orderstatus").alias("unique_row_id"))
    merge_into(folder, rows.filter("o_orderkey % 3 <> 0"), "insert_only", ["unique_row_id"])
    for _ in range(2):
        merge_into(folder, rows, "insert_only", ["unique_row_id"])
    return t.spark.read.parquet(folder)


@query("snk_5_upsert", "SNK-5", "SNK-7", "SNK-11", sql="SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS written FROM customer UNION ALL SELECT -2, 'second' UNION ALL SELECT NULL, 'second'")
def upsert(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "sink")
    merge_into(folder, t.customer.select("c_custkey", F.lit("first").alias("written"), F.lit(0).alias("at")), "replace")
    new = t.customer.filter("c_custkey % 2 = 0").select("c_custkey").union(t.spark.range(-2, -1).toDF("c_custkey")).union(t.spark.sql("SELECT CAST(NULL AS LONG)")).withColumn("written", F.lit("second"))
    early = new.withColumn("written", F.lit("replaced within the batch"))
    batch = new.withColumn("at", F.lit(2)).union(early.withColumn("at", F.lit(1)))
    for _ in range(2):
        merge_into(folder, batch, "upsert", ["c_custkey"], order=["at"])
    return t.spark.read.parquet(folder).drop("at")


@query("snk_10_time_interval", "SNK-10", sql="SELECT o_orderkey, o_orderdate, o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AS rerun FROM orders")
def time_interval(t: Tables) -> DataFrame:
    """A rerun of one year replaces exactly that year's rows."""
    folder = shared_folder(t.spark, "sink")
    rows = t.orders.select("o_orderkey", "o_orderdate")
    merge_into(folder, rows.withColumn("rerun", F.lit(False)), "replace")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    for _ in range(2):
        merge_into(folder, rows.withColumn("rerun", F.lit(True)), "time_interval", column="o_orderdate", start=day("1996-01-01"), end=day("1997-01-01"))
    return t.spark.read.parquet(folder)


@query("snk_11_delete_insert", "SNK-11", sql="SELECT l_orderkey, l_linenumber, 'old' AS version FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, 1, 'new' FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1")
def delete_insert(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "sink")
    merge_into(folder, t.lineitem.filter("l_orderkey % 5 <> 0 or l_linenumber = 1").select("l_orderkey", "l_linenumber", F.lit("old").alias("version")), "replace")
    new = t.lineitem.filter("l_orderkey % 5 = 0 and l_linenumber = 1").select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit("new").alias("version"))
    merge_into(folder, new, "delete_insert", ["l_orderkey"])
    return t.spark.read.parquet(folder)


@query("snk_16_monthly", "SNK-16", sql="SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y-%m') BETWEEN '1995-01' AND '1996-06' THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def monthly_partitions(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "sink")
    write_parquet(monthly(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1995-01", "1996-06").drop("o_orderdate"), folder, partitions=["month"])
    return t.spark.read.schema("o_orderkey long, month string").parquet(folder)


@query("snk_18_messages", "SNK-18", sql="""SELECT event_id::VARCHAR AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def messages(t: Tables) -> DataFrame:
    from millrace.sources.topics import as_messages

    return as_messages(t.events.select("event_id", "event_type"), F.col("event_id"))


@query("snk_19_parallel_chunks", "SNK-19", sql="SELECT count(*)::BIGINT AS n FROM lineitem")
def parallel_chunks(t: Tables) -> DataFrame:
    """One task a partition writes its own files of bounded size."""
    folder = shared_folder(t.spark, "sink")
    write_parquet(t.lineitem.select("l_orderkey"), folder, rows_a_file=100_000)
    return t.spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n"))


LOAD_1, LOAD_2 = "2024-01-01", "2024-02-01"


@query(
    "snk_13_scd2_merge",
    "SNK-13",
    sql=f"""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'X' || c_mktsegment ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 5 <> 0)
SELECT a.k AS c_custkey, a.seg AS c_mktsegment, TIMESTAMP '{LOAD_1}' AS valid_from, CASE WHEN b.k IS NULL OR a.seg <> b.seg THEN TIMESTAMP '{LOAD_2}' END AS valid_to FROM a LEFT JOIN b USING (k)
UNION ALL SELECT b.k, b.seg, TIMESTAMP '{LOAD_2}', NULL FROM b LEFT JOIN a USING (k) WHERE a.k IS NULL OR a.seg <> b.seg""",
)
def scd2_merge(t: Tables) -> DataFrame:
    """Two full loads, each merged twice: changed, new and vanished keys; a rerun changes nothing."""
    folder = shared_folder(t.spark, "sink")
    first = t.customer.filter("c_custkey % 7 <> 0").select("c_custkey", "c_mktsegment")
    renamed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("X"), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    second = t.customer.filter("c_custkey % 5 <> 0").select("c_custkey", renamed.alias("c_mktsegment"))
    for load, day in ((first, LOAD_1), (first, LOAD_1), (second, LOAD_2), (second, LOAD_2)):
        merge_into(folder, load, "scd2", ["c_custkey"], at=F.lit(day).cast("timestamp_ntz"))
    return t.spark.read.parquet(folder)


@query("snk_4_inserted_counts", "SNK-4", sql="SELECT * FROM (SELECT 1 AS load, count(*)::BIGINT AS inserted FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 2, count(*)::BIGINT FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 3, 0::BIGINT)")
def inserted_counts(t: Tables) -> DataFrame:
    """What each load inserts through its staging table."""
    folder = shared_folder(t.spark, "sink")
    loads = [t.orders.filter("o_orderkey % 3 <> 0"), t.orders, t.orders.union(t.orders)]
    counts = [(n, insert_through_staging(folder, load.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])) for n, load in enumerate(loads, start=1)]
    return t.spark.createDataFrame(counts, "load int, inserted long")


@query("snk_14_saved_tables", "SNK-14", sql="SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def saved_tables(t: Tables) -> DataFrame:
    """A view over a source, a table created from it, a query of that table."""
    t.orders.createOrReplaceTempView("millrace_orders")
    t.spark.sql("CREATE OR REPLACE TEMP VIEW millrace_large AS SELECT * FROM millrace_orders WHERE o_totalprice > 50000")
    t.spark.sql("DROP TABLE IF EXISTS millrace_large_by_status")
    folder = shared_folder(t.spark, "ctas")
    t.spark.sql(f"CREATE TABLE millrace_large_by_status USING parquet LOCATION '{folder}' AS SELECT o_orderstatus, count(*) AS n FROM millrace_large GROUP BY o_orderstatus")
    return t.spark.table("millrace_large_by_status")


@query("snk_20_single_evaluation", "SNK-20", sql="SELECT count(*)::BIGINT AS n FROM orders")
def single_evaluation(t: Tables) -> DataFrame:
    """Random row names meet themselves only if both sides of a join read one evaluation."""
    named = evaluated_once(t.orders.select(F.uuid().alias("name")), shared_folder(t.spark, "once"))
    return named.join(named.withColumnRenamed("name", "other"), F.col("name") == F.col("other")).agg(F.count(F.lit(1)).alias("n"))


@query("snk_13_history", "SNK-13", sql="SELECT o_custkey, count(*)::BIGINT AS versions, count(*) FILTER (WHERE valid_to IS NULL)::BIGINT AS current FROM (SELECT o_custkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) GROUP BY 1")
def versions_of(t: Tables) -> DataFrame:
    versions = R.history(t.orders.select("o_custkey", "o_orderdate").distinct(), ["o_custkey"], "o_orderdate")
    return versions.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("versions"), F.count_if("is_current").alias("current"))


@query(
    "sup_1_catalogue",
    "SUP-1",
    sql="SELECT 'status=' || o_orderstatus AS partition, count(*)::BIGINT AS total_rows, true AS in_definition FROM orders GROUP BY 1",
)
def catalogue(t: Tables) -> DataFrame:
    """A saved table's partitions as the catalogue lists them, their rows, and whether its stored definition names the key."""
    name, folder = "millrace_orders_by_status", shared_folder(t.spark, "table")
    t.spark.sql(f"DROP TABLE IF EXISTS {name}")
    t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")).write.partitionBy("status").option("path", folder).saveAsTable(name)
    listed = t.spark.sql(f"SHOW PARTITIONS {name}")
    counted = t.spark.table(name).groupBy(F.concat(F.lit("status="), F.col("status")).alias("partition")).agg(F.count(F.lit(1)).alias("total_rows"))
    definition = t.spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
    return listed.join(counted, "partition", "left").withColumn("in_definition", F.lit("PARTITIONED BY (status)" in definition))


def nested_orders(t: Tables, lines: DataFrame) -> DataFrame:
    """Orders with their items, each with a list of marks: an odd line has two, an even one none."""
    line = F.col("l_linenumber")
    marks = F.when(line % 2 == 1, F.array(line * 10, line * 10 + 1)).otherwise(F.array().cast("array<int>"))
    items = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("l_linenumber", "l_partkey", marks.alias("marks")))))
    return lines.groupBy(F.col("l_orderkey").alias("Order ID")).agg(items.alias("items"))


@query(
    "snk_12_cascaded_merge",
    "SNK-12",
    sql="""WITH lines AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product FROM lineitem WHERE l_orderkey % 3 <> 0
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey + 1 FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2)
SELECT order_id, line, product, unnest(CASE WHEN line % 2 = 1 THEN [line * 10, line * 10 + 1] ELSE [NULL] END)::INT AS mark FROM lines""",
)
def cascaded_merge(t: Tables) -> DataFrame:
    """All orders are loaded, then a third of them again with fewer and changed items: nothing of the old lists stays."""
    folder = shared_folder(t.spark, "nested")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    changed = lines.filter("l_orderkey % 3 = 0").withColumn("l_partkey", F.col("l_partkey") + 1)
    shrunk = changed.withColumn("l_linenumber", F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")))
    merge_nested(folder, nested_orders(t, lines), "orders", "load-1", ["Order ID"])
    paths = merge_nested(folder, nested_orders(t, shrunk), "orders", "load-2", ["Order ID"])
    orders, items, marks = (t.spark.read.parquet(paths[name]) for name in ("orders", "orders__items", "orders__items__marks"))
    of_root = items.join(orders.select(F.col("_dlt_id").alias("_root"), "order_id"), F.col("_dlt_root_id") == F.col("_root"))
    below = marks.select(F.col("_dlt_parent_id").alias("_item"), F.col("value").alias("mark"))
    return of_root.join(below, F.col("_dlt_id") == F.col("_item"), "left").select("order_id", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product"), "mark")


@query(
    "snk_15_clustered",
    "SNK-15",
    sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey BETWEEN 20 AND 24 OR l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-08'",
)
def clustered(t: Tables) -> DataFrame:
    """A table clustered by three columns at once; filters on any of them skip most of it."""
    folder = shared_folder(t.spark, "clustered")
    write_clustered(t.lineitem, folder, ["l_partkey", "l_suppkey", "l_shipdate"], 16, rows_a_group=2_000)
    table, day = t.spark.read.parquet(folder), lambda s: F.lit(s).cast("timestamp_ntz")
    return table.filter(F.col("l_partkey").between(20, 24) | F.col("l_shipdate").between(day("1996-03-01"), day("1996-03-08"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
