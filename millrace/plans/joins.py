"""Joins: inner, outer, keyed by expressions, lateral, interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import delimited, exact_sum
from millrace.operators.relational import small_side
from millrace.registry import Tables, query


@query(
    "join_1_inner_lookup",
    "JOIN-1",
    sql="""SELECT o_orderkey, d.description FROM orders JOIN (VALUES ('F','Finished'),('O','Open'),('Unknown','Unknown')) d(code, description)
  ON coalesce(nullif(o_orderstatus, 'P'), 'Unknown') = d.code""",
)
def inner_lookup(t: Tables) -> DataFrame:
    """The key is coalesced to a default before the lookup."""
    dictionary = t.spark.createDataFrame([("F", "Finished"), ("O", "Open"), ("Unknown", "Unknown")], "code string, description string")
    keyed = t.orders.withColumn("code", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("Unknown")))
    return keyed.join(F.broadcast(dictionary), "code").select("o_orderkey", "description")


@query("join_2_left", "JOIN-2", sql="SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query(
    "join_3_dim_twice",
    "JOIN-3",
    "JOIN-12",
    sql="""SELECT l_orderkey, l_linenumber, pu.n_name AS pickup_zone, dz.n_name AS dropoff_zone FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation pu ON c_nationkey = pu.n_nationkey LEFT JOIN nation dz ON s_nationkey = dz.n_nationkey""",
)
def dim_twice(t: Tables) -> DataFrame:
    zones = small_side(t.nation.select("n_nationkey", "n_name"))
    pickup, dropoff = (zones.select(F.col("n_nationkey").alias(f"{n}_key"), F.col("n_name").alias(f"{n}_zone")) for n in ("pickup", "dropoff"))
    trips = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    trips = trips.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(small_side(t.supplier.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    named = trips.join(pickup, F.col("c_nationkey") == F.col("pickup_key"), "left").join(dropoff, F.col("s_nationkey") == F.col("dropoff_key"), "left")
    return named.select("l_orderkey", "l_linenumber", "pickup_zone", "dropoff_zone")


@query(
    "join_4_constant_in_on",
    "JOIN-4",
    sql="SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F'",
)
def constant_in_on(t: Tables) -> DataFrame:
    """The constants narrow the right side before the join; unmatched rows stay."""
    right = t.lineitem.filter("l_returnflag = 'R' and l_linestatus = 'F'").select("l_orderkey", "l_linenumber")
    return t.orders.join(right, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber")


@query("join_5_in_list_in_on", "JOIN-5", sql="SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R')")
def in_list_in_on(t: Tables) -> DataFrame:
    right = t.lineitem.filter(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber")
    return t.orders.join(right, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber")


@query(
    "join_6_full_outer",
    "JOIN-6",
    sql="""SELECT hour, zone, g.amount AS green_amount, g.n AS green_n, y.amount AS yellow_amount, y.n AS yellow_n FROM
 (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS hour, l_suppkey AS zone, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS amount, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) g
 FULL JOIN
 (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS hour, l_suppkey AS zone, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS amount, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) y
 USING (hour, zone)""",
)
def full_outer(t: Tables) -> DataFrame:
    def revenue(flag: str, name: str) -> DataFrame:
        keys = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("hour"), F.col("l_suppkey").alias("zone")
        return t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(*keys).agg(exact_sum("l_extendedprice").alias(f"{name}_amount"), F.count(F.lit(1)).alias(f"{name}_n"))

    return revenue("R", "green").join(revenue("N", "yellow"), ["hour", "zone"], "outer")


@query("join_7_left_on_true", "JOIN-7", sql="SELECT r_name, m.top FROM region LEFT JOIN (SELECT max(o_totalprice) AS top FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0) m ON 1 = 1")
def left_on_true(t: Tables) -> DataFrame:
    """The scalar side is empty here; every row stays."""
    scalar = t.orders.filter("o_totalprice < 0").agg(F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 0").select("top")
    return t.region.join(scalar, F.lit(True), "left").select("r_name", "top")


@query("join_9_regex_key", "JOIN-9", sql="SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON try_cast(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT) = s_suppkey")
def regex_key(t: Tables) -> DataFrame:
    keyed = t.customer.withColumn("number", F.nullif(F.regexp_extract("c_name", r"([0-9]+)$", 1), F.lit("")).try_cast("long"))
    return keyed.join(t.supplier, F.col("number") == F.col("s_suppkey")).select("c_custkey", "s_suppkey")


@query("join_10_cast_key", "JOIN-10", sql="SELECT doc_id, n_nationkey FROM documents JOIN nation ON try_cast(replace(source, 'src', '') AS BIGINT) = n_nationkey")
def cast_key(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", F.replace("source", F.lit("src"), F.lit("")).try_cast("long").alias("number"))
    return keyed.join(small_side(t.nation.select("n_nationkey")), F.col("number") == F.col("n_nationkey")).select("doc_id", "n_nationkey")


@query("join_11_parent_child", "JOIN-11", sql="SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def parent_child(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("join_13_large_large", "JOIN-13", sql="SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def large_large(t: Tables) -> DataFrame:
    """Both sides shuffled by the key and merged in order, whatever their size."""
    joined = t.orders.select("o_orderkey", "o_orderstatus").hint("merge").join(t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_15_interval",
    "JOIN-15",
    sql="""SELECT a.event_id AS click_id, b.event_id AS view_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id
  AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'view'""",
)
def interval(t: Tables) -> DataFrame:
    """Within five minutes either way, as an equi join on the user and a time bucket.

    Each view is offered to its own five-minute bucket and both neighbours, so a
    busy user's rows spread over many keys.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 300)
    clicks = t.events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"), bucket("ts").alias("b"))
    views = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"), bucket("ts").alias("own"))
    views = views.withColumn("b", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    near = F.col("view_ts").between(F.col("click_ts") - F.expr("interval 5 minutes"), F.col("click_ts") + F.expr("interval 5 minutes"))
    return clicks.join(views, ["user_id", "b"]).filter(near).select("click_id", "view_id", "user_id")


@query("join_16_lateral_function", "JOIN-16", "UDF-3", sql="SELECT p_partkey, trim(theme) AS theme FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS theme FROM part) WHERE trim(theme) <> ''")
def lateral_function(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(delimited(F.col("p_name"), " ")).alias("theme"))


@query("join_16_table_function", "JOIN-16", "UDF-3", sql="SELECT p_partkey, trim(theme) AS theme FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS theme FROM part) WHERE trim(theme) <> ''")
def table_function(t: Tables) -> DataFrame:
    """The same split as a Python table function, for callers who bring their own."""
    from millrace.functions.tables import register_split_items

    register_split_items(t.spark)
    t.part.createOrReplaceTempView("millrace_part")
    return t.spark.sql("SELECT p_partkey, s.item AS theme FROM millrace_part, LATERAL split_items(p_name, ' ') s")


@query("join_17_lateral_series", "JOIN-17", sql="SELECT n_nationkey, unnest(range(1, n_regionkey + 1))::INT AS i FROM nation WHERE n_regionkey >= 1")
def lateral_series(t: Tables) -> DataFrame:
    """A descending sequence for n = 0 is avoided by the filter."""
    return t.nation.filter("n_regionkey >= 1").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.col("n_regionkey"))).alias("i"))


@query("join_18_unnest_items", "JOIN-18", sql="SELECT lower(theme) AS theme, round(avg(p_retailprice), 4)::DOUBLE AS tone, count(*)::BIGINT AS n FROM (SELECT p_retailprice, unnest(string_split(p_name, ' ')) AS theme FROM part) WHERE trim(theme) <> '' GROUP BY 1")
def unnest_items(t: Tables) -> DataFrame:
    exploded = t.part.select("p_retailprice", F.explode(delimited(F.col("p_name"), " ")).alias("theme"))
    return exploded.groupBy(F.lower("theme").alias("theme")).agg(F.round(F.avg("p_retailprice"), 4).alias("tone"), F.count(F.lit(1)).alias("n"))


@query("join_19_unnest_structs", "JOIN-19", sql="SELECT l_orderkey AS order_id, l_partkey AS product, l_extendedprice AS price FROM lineitem")
def unnest_structs(t: Tables) -> DataFrame:
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("product"), F.col("l_extendedprice").alias("price"))).alias("items"))
    return nested.select("order_id", F.inline("items"))


@query("join_20_aggregated_side", "JOIN-20", sql="SELECT c_custkey, coalesce(n, 0)::BIGINT AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def aggregated_side(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("orders"))


@query("join_22_dictionary", "JOIN-22", sql="SELECT l_orderkey, l_linenumber, s_name, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def dictionary(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    named = lines.join(small_side(t.supplier.select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.join(small_side(t.part.filter("p_size < 10").select("p_partkey", "p_name")), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "s_name", "p_name")


@query(
    "sup_10_chained_left_joins",
    "SUP-10",
    sql="SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey",
)
def chained(t: Tables) -> DataFrame:
    """The second key comes out of the first join."""
    first = t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return first.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_name")
