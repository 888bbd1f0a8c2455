"""Data-quality checks over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import checks as C
from millrace.registry import Tables, query


@query(
    "dq_1_to_6_summary",
    "DQ-1",
    "DQ-2",
    "DQ-3",
    "DQ-4",
    "DQ-5",
    "DQ-6",
    sql="""SELECT 'not_null' AS "check", (SELECT count(*) FROM events WHERE value IS NULL)::BIGINT AS failures
UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))::BIGINT
UNION ALL SELECT 'accepted_values', (SELECT count(*) FROM events WHERE event_type NOT IN ('click','view','purchase'))::BIGINT
UNION ALL SELECT 'relationships', (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))::BIGINT
UNION ALL SELECT 'unique_combination', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))::BIGINT
UNION ALL SELECT 'positive', (SELECT count(*) FROM lineitem WHERE l_discount <= 0)::BIGINT
UNION ALL SELECT 'non_negative', (SELECT count(*) FROM customer WHERE c_acctbal < 0)::BIGINT""",
)
def generic(t: Tables) -> DataFrame:
    by_row = [
        C.row_failures(t.events, {"not_null": F.col("value").isNull(), "accepted_values": ~F.col("event_type").isin("click", "view", "purchase")}),
        C.row_failures(t.lineitem, {"positive": F.col("l_discount") <= 0}),
        C.row_failures(t.customer, {"non_negative": F.col("c_acctbal") < 0}),
    ]
    whole = C.summary(
        {
            "unique": C.unique(t.orders, "o_custkey"),
            "relationships": C.relationships(t.lineitem, "l_suppkey", t.supplier.filter("s_acctbal > 0"), "s_suppkey"),
            "unique_combination": C.unique(t.lineitem, "l_orderkey", "l_linenumber"),
        }
    )
    return reduce(DataFrame.union, by_row, whole)


@query("dq_4_orphans", "DQ-4", sql="SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def orphans(t: Tables) -> DataFrame:
    return C.relationships(t.lineitem.select("l_suppkey"), "l_suppkey", t.supplier.filter("s_acctbal > 0"), "s_suppkey").distinct()


@query("dq_7_expected_value", "DQ-7", sql="SELECT (SELECT count(*) FROM orders) > 0 AS has_rows, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)::BIGINT AS duplicates")
def expected_value(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("millrace_orders")
    return t.spark.sql("SELECT count(*) > 0 AS has_rows, count(*) - count(DISTINCT o_orderkey) AS duplicates FROM millrace_orders")


@query("dq_8_singular", "DQ-8", sql="SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS total FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice::DECIMAL(18,4)) < 5000")
def singular(t: Tables) -> DataFrame:
    from millrace.functions.scalars import exact_sum

    return t.lineitem.groupBy("l_orderkey").agg(exact_sum("l_extendedprice").alias("total")).filter("total < 5000")


@query("dq_9_freshness", "DQ-9", sql="SELECT round((epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', max(ts)))) / 3600, 4)::DOUBLE AS age_hours, CASE WHEN (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', max(ts)))) / 3600 > 48 THEN 'error' WHEN (epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', max(ts)))) / 3600 > 12 THEN 'warn' ELSE 'pass' END AS status FROM events")
def freshness(t: Tables) -> DataFrame:
    return C.freshness(t.events, "ts", F.lit("2024-02-01"), 12, 48).withColumn("age_hours", F.round("age_hours", 4))


@query("dq_10_contract", "DQ-10", sql="SELECT * FROM (VALUES ('missing column nation'), ('unexpected column n_name'), ('column n_regionkey is int, not bigint')) v(violation)")
def contract(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    wanted = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("nation", T.StringType()), T.StructField("n_regionkey", T.LongType())])
    return t.spark.createDataFrame([(v,) for v in C.contract_violations(t.nation, wanted)], "violation string")


@query(
    "dq_12_audit",
    "DQ-12",
    sql="""SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'only_a' WHEN n_nationkey >= 25 THEN 'only_b' ELSE 'changed' END AS status
FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey >= 3 AND n_regionkey = 2 UNION ALL SELECT n_nationkey + 25 FROM nation WHERE n_nationkey < 2)""",
)
def audited(t: Tables) -> DataFrame:
    a = t.nation
    b = a.filter("n_nationkey >= 3").withColumn("n_name", F.when(F.col("n_regionkey") == 2, F.lit("renamed")).otherwise(F.col("n_name")))
    new = a.filter("n_nationkey < 2").withColumn("n_nationkey", (F.col("n_nationkey") + 25).cast("int"))
    return C.audit(a, b.unionByName(new), ["n_nationkey"])


@query("dq_12_not_null_share", "DQ-12", sql="SELECT share FROM (SELECT (count(nullif(o_orderstatus, 'P')) / count(*))::DOUBLE AS share FROM orders) WHERE share < 0.999")
def not_null_share(t: Tables) -> DataFrame:
    return C.not_null_share(t.orders.withColumn("status", F.nullif("o_orderstatus", F.lit("P"))), "status", 0.999)
