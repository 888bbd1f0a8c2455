"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import exact_avg, exact_sum, median
from millrace.operators.relational import completion, pivot_codes, small_side, span_shortfall
from millrace.operators.selection import exact_quantile
from millrace.operators.sketches import SKETCH_ERROR, distinct_sketches, united_sketches
from millrace.registry import Tables, query
from millrace.session import shared_folder
from millrace.sources.sinks import evaluated_once


@query(
    "agg_1_revenue_hour_zone",
    "AGG-1",
    sql="""
SELECT date_trunc('hour', o_orderdate::TIMESTAMP) AS hour, c_nationkey::INT AS zone,
  sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS amount, count(*)::BIGINT AS number_records
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""",
)
def revenue_hour_zone(t: Tables) -> DataFrame:
    trips = t.orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    zoned = trips.join(small_side(t.customer.select("c_custkey", "c_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    return zoned.groupBy(F.date_trunc("hour", "o_orderdate").cast("timestamp_ntz").alias("hour"), F.col("c_nationkey").alias("zone")).agg(exact_sum("o_totalprice").alias("amount"), F.count(F.lit(1)).alias("number_records"))


@query(
    "agg_2_monthly_revenue",
    "AGG-2",
    "AGG-21",
    sql="""
SELECT l_suppkey AS zone, date_trunc('month', l_shipdate)::TIMESTAMP AS month, l_returnflag AS service,
  sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS fare, sum(l_discount::DECIMAL(18,4))::DOUBLE AS extra,
  sum(l_tax::DECIMAL(18,4))::DOUBLE AS tax, sum((l_extendedprice * l_discount)::DECIMAL(18,4))::DOUBLE AS tip,
  sum(l_quantity::DECIMAL(18,4))::DOUBLE / count(*) AS avg_passengers, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE / count(*) AS avg_distance
FROM lineitem GROUP BY ALL""",
)
def monthly_revenue(t: Tables) -> DataFrame:
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("zone"), month, F.col("l_returnflag").alias("service")).agg(
        exact_sum("l_extendedprice").alias("fare"),
        exact_sum("l_discount").alias("extra"),
        exact_sum("l_tax").alias("tax"),
        exact_sum(F.col("l_extendedprice") * F.col("l_discount")).alias("tip"),
        exact_avg("l_quantity").alias("avg_passengers"),
        exact_avg("l_extendedprice").alias("avg_distance"),
    )


@query("agg_3_group_count", "AGG-3", sql="SELECT l_returnflag AS service, count(*)::BIGINT AS count FROM lineitem GROUP BY 1")
def group_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("service")).count()


@query("agg_4_global_max", "AGG-4", sql="SELECT max(l_quantity)::DOUBLE AS longest FROM lineitem")
def global_max(t: Tables) -> DataFrame:
    return t.lineitem.groupBy().agg(F.max("l_quantity").alias("longest"))


@query(
    "agg_5_min_max_share",
    "AGG-5",
    sql="""SELECT min(o_orderdate) AS first_day, max(o_orderdate) AS last_day,
  round(100.0 * sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) / count(*), 4)::DOUBLE AS urgent_pct FROM orders""",
)
def min_max_share(t: Tables) -> DataFrame:
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
    return t.orders.agg(F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"), F.round(F.lit(100.0) * urgent / F.count(F.lit(1)), 4).cast("double").alias("urgent_pct"))


@query("agg_6_counts", "AGG-6", sql="SELECT count(*)::BIGINT AS rows_all, count(*) FILTER (WHERE l_discount = 0)::BIGINT AS rows_zero FROM lineitem")
def counts(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("rows_all"), F.count_if(F.col("l_discount") == 0).alias("rows_zero"))


@query("agg_7_distinct", "AGG-7", sql="SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("agg_8_count_distinct", "AGG-8", sql="SELECT count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem")
def count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_9_count_distinct_rows", "AGG-9", sql="SELECT count(DISTINCT (l_returnflag, l_linestatus, l_linenumber))::BIGINT AS n FROM lineitem")
def count_distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct(F.struct("l_returnflag", "l_linestatus", "l_linenumber")).alias("n"))


@query("agg_10_approx_distinct", "AGG-10")
def approx_distinct(t: Tables) -> DataFrame:
    """An estimate within five hundredths; tests compare it with the exact count."""
    return t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts_estimate"))


@query(
    "agg_10_daily_sketches",
    "AGG-10",
    "AGG-16",
    sql="""SELECT event_type, year(ts)::INT AS year, count(DISTINCT date_trunc('day', ts))::BIGINT AS days, count(DISTINCT user_id)::BIGINT AS users, true AS close
FROM events GROUP BY ALL""",
)
def daily_sketches(t: Tables) -> DataFrame:
    """A sketch of the users a day, kept; sketches united a year, without the rows; how near the estimate is to the exact count."""
    daily = distinct_sketches(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id")
    kept = evaluated_once(daily, shared_folder(t.spark, "sketches"))
    yearly = united_sketches(kept.withColumn("year", F.year("day")), ["event_type", "year"], days=F.count(F.lit(1)))
    exact = t.events.groupBy("event_type", F.year("ts").alias("year")).agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), 4 * SKETCH_ERROR * F.col("users"))
    return yearly.join(exact, ["event_type", "year"]).select("event_type", "year", "days", "users", near.alias("close"))


@query("agg_11_median", "AGG-11", sql="SELECT o_orderpriority AS priority, round(median(o_totalprice), 4)::DOUBLE AS median_price FROM orders GROUP BY 1")
def medians(t: Tables) -> DataFrame:
    """Exact by selection where a group is large."""
    found = exact_quantile(t.orders.select(F.col("o_orderpriority").alias("priority"), "o_totalprice"), ["priority"], "o_totalprice")
    return found.select("priority", F.round("quantile", 4).alias("median_price"))


@query("agg_11_median_approximate", "AGG-11")
def medians_approximate(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(median("o_totalprice", exact=False).alias("median_price"))


@query(
    "agg_12_filter_clause",
    "AGG-12",
    sql="SELECT event_type, count(*) FILTER (WHERE value > 15)::BIGINT AS above, count(*) FILTER (WHERE value IS NOT NULL)::BIGINT AS filled FROM events GROUP BY 1",
)
def filter_clause(t: Tables) -> DataFrame:
    t.events.createOrReplaceTempView("millrace_events")
    return t.spark.sql("SELECT event_type, count(*) FILTER (WHERE value > 15) AS above, count(*) FILTER (WHERE value IS NOT NULL) AS filled FROM millrace_events GROUP BY event_type")


@query(
    "agg_13_conditional",
    "AGG-13",
    sql="""SELECT o_custkey AS player, count(CASE WHEN o_orderstatus = 'F' THEN 1 END)::BIGINT AS wins,
  sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS losses FROM orders GROUP BY 1""",
)
def conditional(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.groupBy(F.col("o_custkey").alias("player")).agg(F.count(F.when(status == "F", 1)).alias("wins"), F.sum(F.when(status == "O", 1).otherwise(0)).alias("losses"))


YEARLY = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}


@query(
    "agg_14_pivot_codes",
    "AGG-14",
    sql="SELECT year, "
    + ", ".join(f"max(CASE WHEN code = '{c}' THEN total END) AS {n}" for c, n in YEARLY.items())
    + """ FROM (SELECT year(o_orderdate)::INT AS year, o_orderpriority AS code, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM orders GROUP BY ALL) GROUP BY year""",
)
def pivoted(t: Tables) -> DataFrame:
    long = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("code")).agg(exact_sum("o_totalprice").alias("total"))
    return pivot_codes(long, ["year"], "code", "total", YEARLY)


@query("agg_15_any_value", "AGG-15", sql="SELECT n_regionkey AS region, max(r_name) AS name, count(*)::BIGINT AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def any_value(t: Tables) -> DataFrame:
    """The name is the same in all rows of a region, so any value is the value."""
    named = t.nation.join(small_side(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy(F.col("n_regionkey").alias("region")).agg(F.any_value("r_name").alias("name"), F.count(F.lit(1)).alias("nations"))


@query(
    "agg_16_daily_then_yearly",
    "AGG-16",
    "AGG-17",
    sql="""
WITH day AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, avg(value) AS mean, count(*) AS n
             FROM events WHERE value >= 0 AND value < 10000 GROUP BY ALL)
SELECT event_type AS parameter, year(day)::INT AS year, round(median(mean), 6)::DOUBLE AS median_of_days,
  count(*) FILTER (WHERE round(mean, 9) > 15)::BIGINT AS days_above, count(DISTINCT CASE WHEN round(mean, 9) > 15 THEN user_id END)::BIGINT AS users_above,
  sum(n)::BIGINT AS samples
FROM day GROUP BY ALL""",
)
def daily_then_yearly(t: Tables) -> DataFrame:
    """Days weigh the same whatever their sample count; the limit is strict."""
    valid = t.events.filter((F.col("value") >= 0) & (F.col("value") < 10000))
    day = valid.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    above = F.round("mean", 9) > 15
    keyed = day.select(F.col("event_type").alias("parameter"), F.year("day").alias("year"), "mean", "n", F.when(above, F.col("user_id")).alias("above"))
    found = exact_quantile(keyed, ["parameter", "year"], "mean", days_above=F.count("above"), users_above=F.count_distinct("above"), samples=F.sum("n"))
    return found.select("parameter", "year", F.round("quantile", 6).alias("median_of_days"), "days_above", "users_above", "samples")


@query(
    "agg_18_string_agg",
    "AGG-18",
    sql="SELECT r_name AS region, string_agg(coalesce(n_name, '?'), ' · ' ORDER BY n_nationkey) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def string_agg(t: Tables) -> DataFrame:
    named = t.nation.join(small_side(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", F.coalesce("n_name", F.lit("?")).alias("n_name"))))
    return named.groupBy(F.col("r_name").alias("region")).agg(F.array_join(F.transform(ordered, lambda x: x["n_name"]), " · ").alias("nations"))


@query(
    "agg_19_json_agg",
    "AGG-19",
    sql="""SELECT n_regionkey AS region, '[' || string_agg('{"position":' || n_nationkey || ',"label":"' || n_name || '","kind":null}', ',' ORDER BY n_nationkey) || ']' AS parts FROM nation GROUP BY 1""",
)
def json_agg(t: Tables) -> DataFrame:
    item = F.struct(F.col("n_nationkey").alias("position"), F.col("n_name").alias("label"), F.lit(None).cast("string").alias("kind"))
    return t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.array_sort(F.collect_list(item)), {"ignoreNullFields": "false"}).alias("parts"))


@query("agg_20_having", "AGG-20", sql="SELECT l_partkey AS part, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 20 AND sum(l_quantity) > 500")
def having(t: Tables) -> DataFrame:
    grouped = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return grouped.filter("n > 20 and q > 500").drop("q")


@query(
    "agg_22_completion_pct",
    "AGG-22",
    "SUP-13",
    sql="""SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS total, count(s.k)::BIGINT AS done, round(100.0 * count(s.k) / nullif(count(*), 0), 1)::DOUBLE AS pct
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') s ON o_orderkey = s.k GROUP BY 1""",
)
def completion_pct(t: Tables) -> DataFrame:
    shipped = t.lineitem.filter(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("k")).distinct()
    logged = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")).join(shipped, F.col("o_orderkey") == F.col("k"), "left")
    return completion(logged, ["year"], F.col("k"))


@query(
    "agg_23_span_shortfall",
    "AGG-23",
    sql="""SELECT l_orderkey AS issue, (max(l_linenumber) + 1 - min(l_linenumber))::BIGINT AS expected, count(DISTINCT l_linenumber)::BIGINT AS present,
  (max(l_linenumber) + 1 - min(l_linenumber) - count(DISTINCT l_linenumber))::BIGINT AS missing FROM lineitem GROUP BY 1""",
)
def shortfall(t: Tables) -> DataFrame:
    return span_shortfall(t.lineitem.withColumnRenamed("l_orderkey", "issue"), ["issue"], "l_linenumber")


@query("agg_24_distinct_then_count", "AGG-24", sql="SELECT status, count(*)::BIGINT AS uses FROM (SELECT DISTINCT o_orderstatus AS status, o_custkey FROM orders) GROUP BY 1")
def distinct_then_count(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderstatus").alias("status"), "o_custkey").distinct().groupBy("status").agg(F.count(F.lit(1)).alias("uses"))


@query(
    "agg_25_sum_and_count",
    "AGG-25",
    "UDF-8",
    sql="""SELECT date_trunc('hour', ts) AS hour, user_id AS zone, sum(value::DECIMAL(18,4))::DOUBLE AS revenue, count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL GROUP BY ALL""",
)
def sum_and_count(t: Tables) -> DataFrame:
    """Partial sums on each task, final sums after the shuffle: what a keyed reduce of pairs does."""
    kept = t.events.filter(F.col("value").isNotNull())
    return kept.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("user_id").alias("zone")).agg(exact_sum("value").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_26_group_sum_sorted",
    "AGG-26",
    sql="""SELECT c_mktsegment AS zone, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC""",
)
def group_sum_sorted(t: Tables) -> DataFrame:
    joined = t.orders.join(small_side(t.customer.select("c_custkey", "c_mktsegment")), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("zone")).agg(exact_sum("o_totalprice").alias("total")).orderBy(F.desc("total"))


@query("agg_27_rounded_avg", "AGG-27", sql="SELECT p_brand AS brand, sum(p_retailprice::DECIMAL(18,4))::DOUBLE / count(p_retailprice) AS avg_price FROM part GROUP BY 1")
def rounded_avg(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("brand")).agg(exact_avg("p_retailprice").alias("avg_price"))


@query(
    "agg_29_win_rates",
    "AGG-29",
    "JOIN-8",
    sql="""SELECT s_suppkey AS aid, count(*)::BIGINT AS total_games, count(CASE WHEN l_returnflag = 'A' THEN 1 END)::BIGINT AS wins,
  round(100.0 * count(CASE WHEN l_returnflag = 'A' THEN 1 END) / nullif(count(*), 0), 2)::DOUBLE AS win_pct
FROM supplier LEFT JOIN (SELECT l_returnflag, l_suppkey AS white, (l_partkey % 120 + 1) AS black FROM lineitem WHERE l_linenumber = 1) g
  ON s_suppkey IN (white, black) GROUP BY 1""",
)
def win_rates(t: Tables) -> DataFrame:
    """A player without games still counts one row, as the left join gives."""
    from millrace.operators.relational import either_key_join

    games = t.lineitem.filter("l_linenumber = 1").select("l_returnflag", F.col("l_suppkey").alias("white"), (F.col("l_partkey") % 120 + 1).alias("black"))
    met = either_key_join(t.supplier, games, "s_suppkey", ["white", "black"])
    wins = F.count(F.when(F.col("l_returnflag") == "A", 1))
    total = F.count(F.lit(1))
    return met.groupBy(F.col("s_suppkey").alias("aid")).agg(total.alias("total_games"), wins.alias("wins"), F.round((F.lit(100.0) * wins / F.nullif(total, F.lit(0))).cast("double"), 2).alias("win_pct"))


@query(
    "agg_30_card_of_day",
    "AGG-30",
    sql="""SELECT c_mktsegment AS code, n_name AS name, sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(o_totalprice) AS average
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate::DATE = DATE '1996-01-02' GROUP BY ALL""",
)
def card_of_day(t: Tables, day: str = "1996-01-02") -> DataFrame:
    """The dashboard's "today" is an argument, so the result can be repeated."""
    daily = t.orders.filter(F.to_date("o_orderdate") == F.lit(day).cast("date")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    named = daily.join(small_side(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.groupBy(F.col("c_mktsegment").alias("code"), F.col("n_name").alias("name")).agg(exact_avg("o_totalprice").alias("average"))


@query("agg_31_filtered_count", "AGG-31", sql="SELECT count(*)::BIGINT AS n FROM events WHERE value > 5")
def filtered_count(t: Tables) -> DataFrame:
    return t.events.filter("value > 5").agg(F.count(F.lit(1)).alias("n"))
