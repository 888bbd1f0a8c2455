"""Projections, filters, sorts, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import coded
from millrace.operators.relational import common_columns, ends, keyset_page, not_in, row_before, top, union_all
from millrace.registry import Tables, query

DAY = lambda s: F.lit(s).cast("timestamp_ntz")


@query("prj_1_select", "PRJ-1", sql="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def select(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("prj_2_rename", "PRJ-2", sql="SELECT n_nationkey AS location_id, n_name AS zone, n_regionkey AS borough FROM nation")
def rename(t: Tables) -> DataFrame:
    return t.nation.withColumnsRenamed({"n_nationkey": "location_id", "n_name": "zone", "n_regionkey": "borough"})


@query("prj_3_drop", "PRJ-3", sql="SELECT s_suppkey, s_name FROM supplier")
def drop(t: Tables) -> DataFrame:
    return t.supplier.drop("s_nationkey", "s_acctbal")


@query("prj_4_literal", "PRJ-4", sql="SELECT l_orderkey, l_linenumber, 'green' AS service FROM lineitem WHERE l_returnflag = 'R'")
def literal(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.lit("green").alias("service"))


@query(
    "prj_5_typed",
    "PRJ-5",
    sql="""SELECT l_orderkey::INT AS trip, l_suppkey::SMALLINT AS vendor, l_shipdate::DATE AS day, l_quantity::INT AS passengers,
  l_extendedprice::DECIMAL(18,2)::VARCHAR AS fare, try_cast(l_returnflag AS INT) AS flag FROM lineitem""",
)
def typed(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        c("l_orderkey").cast("int").alias("trip"),
        c("l_suppkey").cast("short").alias("vendor"),
        c("l_shipdate").cast("date").alias("day"),
        c("l_quantity").cast("int").alias("passengers"),
        c("l_extendedprice").cast("decimal(18,2)").cast("string").alias("fare"),
        c("l_returnflag").try_cast("int").alias("flag"),
    )


@query("prj_6_arithmetic", "PRJ-6", sql="SELECT l_orderkey, l_linenumber, round(100.0 * l_tax / nullif(l_discount, 0), 4)::DOUBLE AS pct, round(l_extendedprice * (1 - l_discount), 4)::DOUBLE AS net FROM lineitem")
def arithmetic(t: Tables) -> DataFrame:
    pct = F.lit(100.0) * F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(pct, 4).alias("pct"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("prj_7_common_columns", "PRJ-7", sql="SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, 'customer' AS service FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'supplier' FROM supplier")
def shared_columns(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    shared = common_columns(a, b)
    return a.select(*shared, F.lit("customer").alias("service")).union(b.select(*shared, F.lit("supplier").alias("service")))


@query("prj_8_computed", "PRJ-8", sql="SELECT event_id, ts AS event_time, (epoch_us(ts) // 1000)::BIGINT AS event_ms FROM events")
def computed(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("ts").alias("event_time"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"))


@query("prj_9_struct_field", "PRJ-9", sql="SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def struct_field(t: Tables) -> DataFrame:
    nested = t.customer.select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("account"))
    return nested.select("c_custkey", "account.segment", "account.balance")


# --- filters ------------------------------------------------------------------------


@query("flt_1_comparison", "FLT-1", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_quantity <= 10")
def comparison(t: Tables) -> DataFrame:
    return t.lineitem.filter((F.col("l_returnflag") == "A") & (F.col("l_quantity") <= 10)).select("l_orderkey", "l_linenumber")


@query("flt_2_nulls", "FLT-2", sql="SELECT count(*) FILTER (WHERE value IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE value IS NOT NULL)::BIGINT AS filled FROM events")
def nulls(t: Tables) -> DataFrame:
    return t.events.agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value").isNotNull()).alias("filled"))


@query("flt_3_half_open", "FLT-3", sql="SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
def half_open(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderdate") >= DAY("1996-01-01")) & (F.col("o_orderdate") < DAY("1996-02-01"))).select("o_orderkey", "o_orderdate")


@query("flt_4_between", "FLT-4", sql="SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-15'")
def between(t: Tables) -> DataFrame:
    return t.lineitem.filter(F.col("l_shipdate").between(DAY("1996-03-01"), DAY("1996-03-15"))).select("l_suppkey").distinct()


@query("flt_5_in_list", "FLT-5", sql="SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def in_list(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("flt_6_in_subquery", "FLT-6", sql="SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(t: Tables) -> DataFrame:
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("flt_7_not_in_subquery", "FLT-7", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in_subquery(t: Tables) -> DataFrame:
    """NOT IN, not an anti join: one null among the orders' customers empties the result."""
    return not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.select("o_custkey"))


@query("flt_8_valid_range", "FLT-8", sql="SELECT event_id, value FROM events WHERE value >= 0 AND value < 10000")
def valid_range(t: Tables) -> DataFrame:
    return t.events.filter("value >= 0 and value < 10000").select("event_id", "value")


@query("flt_9_not_empty", "FLT-9", sql="SELECT doc_id FROM documents WHERE lang <> '' AND source <> ''")
def not_empty(t: Tables) -> DataFrame:
    return t.documents.filter((F.col("lang") != "") & (F.col("source") != "")).select("doc_id")


@query("flt_10_any_all", "FLT-10", sql="SELECT doc_id FROM documents WHERE list_contains(['de', 'fr'], lang) AND NOT list_contains(['src1', 'src2'], source)")
def any_all(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("lang").isin("de", "fr") & ~F.col("source").isin("src1", "src2")).select("doc_id")


@query("flt_11_ilike", "FLT-11", sql="SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%RED%' OR p_type ILIKE '%a%') AND NOT p_brand ILIKE '%3%'")
def ilike(t: Tables) -> DataFrame:
    return t.part.filter((F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("%a%")) & ~F.col("p_brand").ilike("%3%")).select("p_partkey", "p_name")


def date_ranges(column: str, ranges: list[tuple[str | None, str | None]]):
    """Any of the ranges, either end open."""
    out = F.lit(False)
    for start, end in ranges:
        inside = F.lit(True)
        if start:
            inside = inside & (F.col(column) >= DAY(start))
        if end:
            inside = inside & (F.col(column) <= DAY(end))
        out = out | inside
    return out


@query(
    "flt_12_date_ranges",
    "FLT-12",
    sql="""SELECT o_orderkey FROM orders WHERE (o_orderdate <= TIMESTAMP '1993-01-01' OR (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01'))
  AND NOT (o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate <= TIMESTAMP '1996-06-01')""",
)
def ranges(t: Tables) -> DataFrame:
    wanted = date_ranges("o_orderdate", [(None, "1993-01-01"), ("1996-01-01", "1997-01-01")])
    return t.orders.filter(wanted & ~date_ranges("o_orderdate", [("1996-05-01", "1996-06-01")])).select("o_orderkey")


def partial_key(**parts):
    """Equality on the parts that are given."""
    out = F.lit(True)
    for column, value in parts.items():
        if value is not None:
            out = out & (F.col(column) == value)
    return out


@query("flt_13_partial_reference", "FLT-13", "FLT-17", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey = 3 OR (l_suppkey = 5 AND l_linenumber = 2)) AND NOT (l_suppkey = 3 AND l_linenumber = 1)")
def partial_reference(t: Tables) -> DataFrame:
    wanted = partial_key(l_suppkey=3, l_linenumber=None) | partial_key(l_suppkey=5, l_linenumber=2)
    return t.lineitem.filter(wanted & ~partial_key(l_suppkey=3, l_linenumber=1)).select("l_orderkey", "l_linenumber")


@query("flt_14_row_comparison", "FLT-14", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_partkey, l_linenumber) < (20, 500, 3)")
def row_comparison(t: Tables) -> DataFrame:
    return t.lineitem.filter(row_before(["l_suppkey", "l_partkey", "l_linenumber"], [F.lit(20).cast("long"), F.lit(500).cast("long"), F.lit(3)])).select("l_orderkey", "l_linenumber")


@query("flt_15_regex", "FLT-15", sql="SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[02468]$')")
def regex(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_name").rlike("[02468]$")).select("c_custkey")


@query("flt_16_relative_time", "FLT-16", sql="SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 1 DAY AND strftime(ts, '%Y%m%d%H%M%S')::BIGINT < 20240115000000")
def relative_time(t: Tables, now: str = "2024-01-15") -> DataFrame:
    """ "now" is an argument, so the result can be repeated."""
    at = F.lit(now).cast("timestamp_ntz")
    stamp = F.date_format("ts", "yyyyMMddHHmmss").cast("long")
    return t.events.filter((F.col("ts") >= at - F.expr("interval 1 day")) & (stamp < F.date_format(at, "yyyyMMddHHmmss").cast("long"))).select("event_id")


@query("flt_18_whitelist", "FLT-18", sql="SELECT count(*) FILTER (WHERE event_type IN ('click','view') AND value IS NOT NULL)::BIGINT AS published, count(*) FILTER (WHERE NOT (event_type IN ('click','view') AND value IS NOT NULL))::BIGINT AS skipped FROM events")
def whitelist(t: Tables) -> DataFrame:
    keep = F.col("event_type").isin("click", "view") & F.col("value").isNotNull()
    return t.events.agg(F.count_if(keep).alias("published"), F.count_if(~keep).alias("skipped"))


# --- sort, limit, paging ---------------------------------------------------------------


@query("top_1_limit", "TOP-1", "TOP-8", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limited(t: Tables) -> DataFrame:
    return top(t.orders.select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("top_2_largest", "TOP-2", "TOP-10", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 1")
def largest(t: Tables) -> DataFrame:
    return top(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), 1, F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"))


@query(
    "top_3_both_ends",
    "TOP-3",
    "TOP-5",
    sql="""SELECT * FROM (SELECT o_orderkey, o_orderdate, 'recent' AS "group" FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_orderdate, 'oldest' FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5)""",
)
def both_ends(t: Tables) -> DataFrame:
    both = ends(t.orders.select("o_orderkey", "o_orderdate"), 5, [F.desc("o_orderdate"), F.desc("o_orderkey")], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return both.orderBy(F.when(F.col("group") == "recent", 0).otherwise(1), F.desc("o_orderdate"))


@query(
    "top_4_detail_of_top",
    "TOP-4",
    "JOIN-21",
    sql="""WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM k)""",
)
def detail_of_top(t: Tables) -> DataFrame:
    best = top(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), F.asc("o_custkey"))
    return t.orders.join(F.broadcast(best.select("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "top_6_keyset_page",
    "TOP-6",
    sql="""SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-06-01', 1000::BIGINT)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21""",
)
def page(t: Tables) -> DataFrame:
    import datetime

    keyed = t.orders.select(F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey")
    found = keyset_page(keyed, ["o_orderdate", "o_orderkey"], 20, (datetime.datetime(1997, 6, 1, tzinfo=datetime.timezone.utc), 1000))
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "top_7_facets",
    "TOP-7",
    "AGG-28",
    sql="""WITH f AS (SELECT * FROM documents WHERE n_chars > 500)
SELECT * FROM (SELECT 'section' AS facet, lang AS name, count(*)::BIGINT AS n FROM f GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'organisation', source, count(*)::BIGINT AS n FROM f GROUP BY 2 ORDER BY n DESC, source LIMIT 15)
UNION ALL SELECT 'total', NULL, count(*)::BIGINT FROM f""",
)
def facets(t: Tables) -> DataFrame:
    from millrace.operators.search import facet_counts

    return facet_counts(t.documents.filter("n_chars > 500"), {"section": ("lang", 10), "organisation": ("source", 15)})


@query("top_9_sort_in_subquery", "TOP-9", sql="SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def useless_sort(t: Tables) -> DataFrame:
    """The optimizer removes the inner sort."""
    return t.orders.orderBy("o_orderdate").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("top_11_work_queue", "TOP-11", sql="SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def work_queue(t: Tables) -> DataFrame:
    return top(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate"), 50, F.asc("o_orderdate"), F.asc("o_orderkey"))


# --- sets ---------------------------------------------------------------------------------


@query(
    "set_1_positional_union",
    "SET-1",
    sql="SELECT l_orderkey AS trip, l_tax AS ehail_fee, 'green' AS service FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_discount, 'yellow' FROM lineitem WHERE l_returnflag = 'A'",
)
def positional_union(t: Tables) -> DataFrame:
    """By position on purpose: the second input misspells a column."""
    green = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("trip"), F.col("l_tax").alias("ehail_fee"), F.lit("green").alias("service"))
    yellow = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("trip"), F.col("l_discount").alias("enhail_fee"), F.lit("yellow").alias("service"))
    return union_all([green, yellow])


@query(
    "set_2_tagged_dictionaries",
    "SET-2",
    sql="""SELECT n_nationkey AS code, n_name AS label, 'nation' AS kind, 1 AS priority FROM nation UNION ALL SELECT r_regionkey, r_name, 'region', 2 FROM region
UNION ALL SELECT s_suppkey::INT, s_name, 'supplier', NULL FROM supplier""",
)
def tagged(t: Tables) -> DataFrame:
    tag = lambda df, code, label, kind, priority: df.select(F.col(code).cast("int").alias("code"), F.col(label).alias("label"), F.lit(kind).alias("kind"), F.lit(priority).cast("int").alias("priority"))
    return union_all([tag(t.nation, "n_nationkey", "n_name", "nation", 1), tag(t.region, "r_regionkey", "r_name", "region", 2), tag(t.supplier, "s_suppkey", "s_name", "supplier", None)])


@query("set_3_union_distinct", "SET-3", sql="SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set_4_tolerant_union", "SET-4", "SRC-19", sql="SELECT c_custkey AS k, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def tolerant(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k"))
    return union_all([a, b], tolerant=True)


@query("set_5_scalar_results", "SET-5", sql="SELECT 'orders' AS name, count(*)::VARCHAR AS result FROM orders UNION ALL SELECT 'latest', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders")
def scalar_results(t: Tables) -> DataFrame:
    n = t.orders.agg(F.count(F.lit(1)).cast("string").alias("result")).select(F.lit("orders").alias("name"), "result")
    latest = t.orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("result")).select(F.lit("latest").alias("name"), "result")
    return n.union(latest)


@query("udf_1_duration_bucket", "UDF-1", sql="SELECT event_id, CASE WHEN abs(value) < 5 THEN '<5' WHEN abs(value) < 10 THEN '<10' WHEN abs(value) < 15 THEN '<15' ELSE '>=15' END AS bucket FROM events")
def duration_bucket(t: Tables) -> DataFrame:
    from millrace.functions.scalars import bucket_by

    return t.events.select("event_id", bucket_by(F.abs("value"), [(5, "<5"), (10, "<10"), (15, "<15")], ">=15").alias("bucket"))


@query("udf_2_hours", "UDF-2", sql="SELECT l_orderkey, l_linenumber, ((epoch(l_shipdate) - epoch(o_orderdate)) / 3600)::FLOAT::DOUBLE AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def hours(t: Tables) -> DataFrame:
    """A float of hours by column arithmetic instead of a row-at-a-time function."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return joined.select("l_orderkey", "l_linenumber", ((seconds("l_shipdate") - seconds("o_orderdate")) / 3600).cast("float").cast("double").alias("hours"))


@query("udf_5_lower", "UDF-5", sql="SELECT p_partkey, lower(p_name) AS name FROM part")
def lower(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.lower("p_name").alias("name"))


@query("udf_6_vendor_names", "UDF-6", sql="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS status FROM orders")
def vendor_names(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", coded("o_orderstatus", {"F": "Finished", "O": "Open"}).alias("status"))


@query("udf_7_batch_model", "UDF-7", sql="SELECT l_orderkey, l_linenumber, l_quantity * 5 AS predicted FROM lineitem")
def batch_model(t: Tables) -> DataFrame:
    """A model in Python, applied to Arrow batches."""

    def predict(batches):
        for pdf in batches:
            yield pdf.assign(predicted=pdf["l_quantity"] * 5)[["l_orderkey", "l_linenumber", "predicted"]]

    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").mapInPandas(predict, "l_orderkey long, l_linenumber int, predicted double")


@query("udf_9_map_filter_yield", "UDF-9", sql="SELECT doc_id, lower(unnest(string_split(source, 'r'))) AS item FROM documents WHERE n_chars > 1000")
def map_filter_yield(t: Tables) -> DataFrame:
    """map, filter, and 0..n rows out of one, as column expressions."""
    return t.documents.filter("n_chars > 1000").select("doc_id", F.explode(F.split("source", "r")).alias("item")).withColumn("item", F.lower("item"))
