"""Dimensional marts and completion reports built from several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import exact_sum, percent
from millrace.operators.relational import completion, decode_fragments, history, pivot_codes, small_side
from millrace.operators.selection import exact_quantile
from millrace.registry import Tables, query


@query(
    "mart_country_year",
    "JOIN-6",
    "AGG-14",
    "AGG-16",
    sql="""WITH air AS (SELECT user_id % 25 AS country, year(day)::INT AS year, round(median(mean), 6)::DOUBLE AS pollution FROM
   (SELECT user_id, date_trunc('day', ts) AS day, avg(value) AS mean FROM events GROUP BY ALL) GROUP BY ALL),
eco AS (SELECT c_nationkey::BIGINT AS country, year(o_orderdate)::INT AS year, max(CASE WHEN s = 'F' THEN v END) AS finished, max(CASE WHEN s = 'O' THEN v END) AS open FROM
   (SELECT c_nationkey, o_orderdate, o_orderstatus AS s, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY c_nationkey, year(o_orderdate), o_orderstatus)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL)
SELECT coalesce(air.country, eco.country)::BIGINT AS country, coalesce(air.year, eco.year)::INT AS year, pollution, finished, open, air.country IS NOT NULL AND eco.country IS NOT NULL AS complete
FROM air FULL JOIN eco ON air.country = eco.country AND air.year = eco.year""",
)
def country_year(t: Tables) -> DataFrame:
    """Two sources reconciled by country and year; either side may be alone."""
    day = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    keyed = day.select((F.col("user_id") % 25).alias("country"), F.year("day").alias("year"), "mean")
    air = exact_quantile(keyed, ["country", "year"], "mean").select("country", "year", F.round("quantile", 6).alias("pollution"))
    long = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("country")), F.col("o_custkey") == F.col("c_custkey"))
    long = long.groupBy("country", F.year("o_orderdate").alias("year"), "o_orderstatus").agg(exact_sum("o_totalprice").alias("v"))
    eco = pivot_codes(long, ["country", "year"], "o_orderstatus", "v", {"F": "finished", "O": "open"})
    both = air.withColumn("a", F.lit(True)).join(eco.withColumn("e", F.lit(True)), ["country", "year"], "outer")
    return both.select("country", "year", "pollution", "finished", "open", (F.col("a").isNotNull() & F.col("e").isNotNull()).alias("complete"))


@query(
    "mart_decode_fragments",
    "TXT-15",
    "SET-3",
    "JOIN-17",
    "WIN-3",
    sql="""WITH d AS (SELECT upper(left(n_name, 3)) AS code, min(n_name) AS label FROM nation GROUP BY 1),
c AS (SELECT DISTINCT upper(left(a.n_name, 3)) || CASE WHEN b.n_nationkey % 3 = 0 THEN 'ZZZ' WHEN b.n_nationkey % 3 = 1 THEN upper(left(b.n_name, 3)) ELSE '' END || CASE WHEN a.n_nationkey = 4 THEN 'Q' ELSE '' END AS code FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT c.code, CASE WHEN w.label IS NOT NULL THEN w.label WHEN length(c.code) % 3 <> 0 THEN '[' || c.code || ']'
  ELSE (SELECT string_agg(coalesce(d.label, '[' || p.f || ']'), ' · ' ORDER BY p.i) FROM (SELECT i, substring(c.code, 3 * i - 2, 3) AS f FROM range(1, 5) r(i) WHERE i <= length(c.code) // 3) p LEFT JOIN d ON d.code = p.f) END AS label
FROM c LEFT JOIN d w ON w.code = c.code""",
)
def decoded(t: Tables) -> DataFrame:
    short = F.upper(F.left("n_name", F.lit(3)))
    dictionary = t.nation.select(short.alias("code"), F.col("n_name").alias("label"), F.lit("nation").alias("kind"), F.lit(1).alias("priority"))
    a, b = t.nation.alias("a"), t.nation.alias("b")
    head, tail = F.upper(F.left("a.n_name", F.lit(3))), F.upper(F.left("b.n_name", F.lit(3)))
    rest = F.when(F.col("b.n_nationkey") % 3 == 0, "ZZZ").when(F.col("b.n_nationkey") % 3 == 1, tail).otherwise("")
    pairs = a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    codes = pairs.select(F.concat(head, rest, F.when(F.col("a.n_nationkey") == 4, "Q").otherwise("")).alias("code"))
    return decode_fragments(codes, "code", dictionary).select("code", "label")


@query(
    "mart_year_overview",
    "SNK-17",
    "JOIN-20",
    sql="""SELECT y.year, y.issues, coalesce(d.documents, 0)::BIGINT AS documents, round(100.0 * coalesce(d.documents, 0) / nullif(y.issues, 0), 1)::DOUBLE AS pct FROM
 (SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS issues FROM orders GROUP BY 1) y LEFT JOIN
 (SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_orderkey) AS documents FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 4 GROUP BY 1) d USING (year)""",
)
def year_overview(t: Tables) -> DataFrame:
    year = F.year("o_orderdate").alias("year")
    issues = t.orders.groupBy(year).agg(F.count(F.lit(1)).alias("issues"))
    fourth = t.lineitem.filter("l_linenumber = 4").select("l_orderkey")
    documents = t.orders.join(fourth, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(year).agg(F.count_distinct("o_orderkey").alias("documents"))
    joined = issues.join(documents, "year", "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long"))
    return joined.withColumn("pct", percent(F.col("documents"), F.col("issues")))


@query(
    "mart_archive_completion",
    "JOIN-7",
    "SUP-12",
    sql="""SELECT a.total, coalesce(d.done, 0)::BIGINT AS done, round(100.0 * coalesce(d.done, 0) / nullif(a.total, 0), 1)::DOUBLE AS pct FROM (SELECT count(*)::BIGINT AS total FROM orders) a
LEFT JOIN (SELECT count(*)::BIGINT AS done FROM orders WHERE o_orderstatus = 'F') d ON 1 = 1""",
)
def archive_completion(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count(F.lit(1)).alias("total"))
    done = t.orders.filter("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("done"))
    both = total.join(done, F.lit(True), "left").withColumn("done", F.coalesce("done", F.lit(0)).cast("long"))
    return both.withColumn("pct", percent(F.col("done"), F.col("total")))


@query(
    "mart_issue_details",
    "SUP-12",
    "JOIN-4",
    sql="""SELECT o_orderkey AS issue, count(*)::BIGINT AS total, count(CASE WHEN l_linestatus = 'F' THEN 1 END)::BIGINT AS done, round(100.0 * count(CASE WHEN l_linestatus = 'F' THEN 1 END) / nullif(count(*), 0), 1)::DOUBLE AS pct
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def issue_details(t: Tables) -> DataFrame:
    joined = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_linestatus"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return completion(joined.withColumnRenamed("o_orderkey", "issue"), ["issue"], F.when(F.col("l_linestatus") == "F", 1))


@query("mart_long_format", "SUP-11", sql="SELECT n_name AS country, 'acctbal' AS indicator, round(avg(c_acctbal), 4)::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING avg(c_acctbal) IS NOT NULL")
def long_format(t: Tables) -> DataFrame:
    joined = t.customer.join(small_side(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("country")).agg(F.lit("acctbal").alias("indicator"), F.round(F.avg("c_acctbal"), 4).alias("value")).filter("value is not null")


@query("mart_scd2", "SNK-13", sql="SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1)")
def scd2(t: Tables) -> DataFrame:
    from millrace.operators.relational import keep_first

    versions = keep_first(t.orders, ["o_custkey", "o_orderdate"], [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"))
    return history(versions, ["o_custkey"], "valid_from").select("o_custkey", "o_orderkey", "valid_from", "valid_to")
