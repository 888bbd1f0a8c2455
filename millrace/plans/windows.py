"""Analytic windows: dedupe, latest, best match, base index, carry-forward, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import exact_sum
from millrace.operators import scans
from millrace.operators.relational import best_matches, keep_first, small_side
from millrace.operators.scans import carried_forward, indexed, sessions
from millrace.registry import Tables, query


@query(
    "win_1_dedupe_latest",
    "WIN-1",
    sql="""SELECT user_id, event_type, hour, event_id FROM (
  SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' AND value >= 0) WHERE rn = 1""",
)
def dedupe_latest(t: Tables) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    window = t.events.filter((F.col("ts") >= day("2024-01-02")) & (F.col("ts") < day("2024-01-20")) & (F.col("value") >= 0))
    keyed = window.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return keep_first(keyed, ["user_id", "event_type", "hour"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "hour", "event_id")


@query("win_2_qualify", "WIN-2", sql="SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_custkey, o_orderkey) = 1")
def qualify(t: Tables) -> DataFrame:
    """With a total order added, so that the survivor is not arbitrary."""
    return keep_first(t.orders, ["o_custkey"], [F.asc("o_custkey"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(
    "win_3_best_by_priority",
    "WIN-3",
    sql="""SELECT c_custkey, label FROM (SELECT c_custkey, label, row_number() OVER (PARTITION BY c_custkey ORDER BY priority NULLS LAST, kind) AS rn
FROM customer LEFT JOIN (SELECT n_nationkey AS code, n_name AS label, 'nation' AS kind, NULL::INT AS priority FROM nation
  UNION ALL SELECT r_regionkey, r_name, 'region', 1 FROM region) ON c_nationkey = code) WHERE rn = 1""",
)
def best_by_priority(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"), F.lit("nation").alias("kind"), F.lit(None).cast("int").alias("priority"))
    regions = t.region.select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"), F.lit("region").alias("kind"), F.lit(1).alias("priority"))
    people = t.customer.select("c_custkey", F.col("c_nationkey").alias("code"))
    return best_matches(people, small_side(nations.union(regions)), "code", ["c_custkey"], "priority", "kind").select("c_custkey", "label")


@query("win_4_latest_per_key", "WIN-4", sql="SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return keep_first(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "win_5_index_base_100",
    "WIN-5",
    sql="""WITH m AS (SELECT c_nationkey AS nation, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT nation, year, revenue, round(100.0 * revenue / nullif(first_value(revenue) OVER (PARTITION BY nation ORDER BY year), 0), 2)::DOUBLE AS index_100 FROM m""",
)
def index_base(t: Tables) -> DataFrame:
    yearly = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("nation")), F.col("o_custkey") == F.col("c_custkey"))
    yearly = yearly.groupBy("nation", F.year("o_orderdate").alias("year")).agg(exact_sum("o_totalprice").alias("revenue"))
    return indexed(yearly, ["nation"], "year", "revenue")


@query("win_6_distinct_on", "WIN-6", sql="SELECT DISTINCT ON (lang, source) lang, source, doc_id FROM documents ORDER BY lang, source, n_chars DESC, doc_id")
def distinct_on(t: Tables) -> DataFrame:
    return keep_first(t.documents.select("lang", "source", "n_chars", "doc_id"), ["lang", "source"], [F.desc("n_chars"), F.asc("doc_id")]).select("lang", "source", "doc_id")


@query(
    "win_7_carry_forward",
    "WIN-7",
    sql="""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'section ' || event_id END AS heading,
   sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events)
SELECT user_id, event_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY event_id) AS heading FROM e""",
)
def carry_forward(t: Tables) -> DataFrame:
    """Headings hold until the next one; an error row resets them."""
    heading = F.when(F.col("event_type") == "signup", F.concat(F.lit("section "), F.col("event_id").cast("string")))
    marked = t.events.select("user_id", "event_id", "event_type", heading.alias("heading"))
    return carried_forward(marked, ["user_id"], "event_id", "heading", F.col("event_type") == "error").select("user_id", "event_id", "heading")


@query(
    "win_8_gap_segments",
    "WIN-8",
    sql="""WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
m AS (SELECT user_id, median(gap) AS typical FROM g GROUP BY 1)
SELECT user_id, event_id, (sum(CASE WHEN gap > 1.6 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS paragraph FROM g JOIN m USING (user_id)""",
)
def gap_segments(t: Tables) -> DataFrame:
    """A new segment after a gap of more than 1.6 times the key's median gap."""
    timed = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return scans.gap_segments(timed, "user_id", "us", "event_id", 1.6).select("user_id", "event_id", "paragraph")


@query(
    "win_sessions_batch",
    "STR-12",
    sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS trips FROM s GROUP BY ALL""",
)
def sessions_batch(t: Tables) -> DataFrame:
    return sessions(t.events.select("user_id", "ts"), "user_id", "ts", 300).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("trips"))
