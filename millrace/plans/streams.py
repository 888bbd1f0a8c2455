"""Streaming queries over the events table; results are checked against the batch equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import delimited, exact_sum
from millrace.operators.relational import small_side
from millrace.registry import Tables, query
from millrace.session import shared_folder
from millrace.streaming import flows, stateful


def rows() -> Column:
    return F.count(F.lit(1))


def events(t: Tables, delay: str = "5 seconds") -> DataFrame:
    return flows.event_time(flows.file_stream(t.spark, t.path("events")), "ts", delay)


def bucketed(size: str, keys: str, aggregates: str, where: str = "") -> str:
    """The batch equivalent of a tumbling window in DuckDB."""
    return f"""SELECT time_bucket(INTERVAL '{size}', ts) AS window_start, time_bucket(INTERVAL '{size}', ts) + INTERVAL '{size}' AS window_end,
  {keys} {aggregates} FROM events {where} GROUP BY ALL"""


@query("str_3_tumble_sum", "STR-1", "STR-3", "STR-14", "STR-16", sql=bucketed("5 minutes", "user_id,", "count(*)::BIGINT AS trips, sum(value::DECIMAL(18,4))::DOUBLE AS revenue"))
def tumble_sum(t: Tables) -> DataFrame:
    return flows.materialize(flows.tumbling(events(t), "ts", "5 minutes", ["user_id"], rows().alias("trips"), exact_sum("value").alias("revenue")))


@query("str_4_tumble_count", "STR-4", sql=bucketed("15 minutes", "event_type,", "count(*)::BIGINT AS n"))
def tumble_count(t: Tables) -> DataFrame:
    return flows.materialize(flows.tumbling(events(t), "ts", "15 minutes", ["event_type"], rows().alias("n")))


@query("str_5_tumble_global", "STR-5", sql=bucketed("1 hour", "", "sum(value::DECIMAL(18,4))::DOUBLE AS tips"))
def tumble_global(t: Tables) -> DataFrame:
    return flows.materialize(flows.tumbling(events(t), "ts", "1 hour", [], exact_sum("value").alias("tips")))


@query("str_6_hourly", "STR-2", "STR-6", sql=bucketed("1 hour", "user_id, event_type,", "round(avg(value), 6)::DOUBLE AS mean, count(*)::BIGINT AS n"))
def hourly(t: Tables) -> DataFrame:
    return flows.materialize(flows.tumbling(events(t, "5 minutes"), "ts", "1 hour", ["user_id", "event_type"], F.round(F.avg("value"), 6).alias("mean"), rows().alias("n")))


@query("str_6_daily", "STR-6", sql=bucketed("1 day", "user_id, event_type,", "round(avg(value), 6)::DOUBLE AS mean, count(*)::BIGINT AS n"))
def daily(t: Tables) -> DataFrame:
    return flows.materialize(flows.tumbling(events(t, "5 minutes"), "ts", "1 day", ["user_id", "event_type"], F.round(F.avg("value"), 6).alias("mean"), rows().alias("n")))


@query(
    "str_12_sessions",
    "STR-12",
    sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 5 MINUTE AS window_end, user_id, count(*)::BIGINT AS trips FROM s GROUP BY user_id, session""",
)
def session_windows(t: Tables) -> DataFrame:
    return flows.materialize(flows.session(events(t), "ts", "5 minutes", ["user_id"], rows().alias("trips")))


@query("str_13_append_closed", "STR-13", "STR-19", sql=f"SELECT * FROM ({bucketed('5 minutes', 'user_id,', 'count(*)::BIGINT AS trips')}) WHERE window_end <= (SELECT max(ts) - INTERVAL 5 SECOND FROM events)")
def append_closed(t: Tables) -> DataFrame:
    """Append mode gives a window once, when the watermark has passed its end; the open tail is withheld."""
    return flows.materialize(flows.tumbling(events(t), "ts", "5 minutes", ["user_id"], rows().alias("trips")), "append")


@query("str_7_update_upsert", "SNK-7", sql=bucketed("1 hour", "event_type,", "count(*)::BIGINT AS n"))
def update_upsert(t: Tables) -> DataFrame:
    """Changed groups of each micro-batch, merged by key."""
    counted = flows.tumbling(events(t), "ts", "1 hour", ["event_type"], rows().alias("n"))
    return flows.materialize(counted, "update", ["window_start", "window_end", "event_type"])


@query("str_15_interval_join", "STR-15", "STR-17", "JOIN-15", sql="""SELECT a.event_id AS click_id, b.event_id AS view_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id
  AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def interval_join(t: Tables) -> DataFrame:
    side = lambda kind, name: events(t, "1 hour").filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"), "user_id")
    joined = flows.interval_join(side("click", "click"), side("view", "view"), "user_id", "click_ts", "view_ts", "5 minutes")
    return flows.materialize(joined.select("click_id", "view_id", "user_id"), "append")


@query(
    "str_15_state_ttl",
    "STR-15",
    sql="""WITH e AS (SELECT user_id, event_id, event_type, ts, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'click') AND user_id IS NOT NULL),
s AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS view_id, last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER w AS view_us
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, event_id AS click_id, view_id, us - view_us AS age_us FROM s WHERE event_type = 'click' AND us - view_us < 600000000
  AND us // 1000 < (SELECT max(us) // 1000 - 7200000 FROM e)""",
)
def state_ttl(t: Tables) -> DataFrame:
    """Clicks with their user's last view, which is forgotten after ten minutes; rows arrive up to an hour late in six batches."""
    rows = t.events.filter("event_type in ('view', 'click')").select("user_id", "event_id", "event_type", "ts")
    span = rows.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("hi")).first()
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 7 * 600
    stream = flows.event_time(stateful.arriving(rows, F.floor((arrival - (span["lo"] or 0)) * 6 / max(1, (span["hi"] or 0) - (span["lo"] or 0) + 3600)), 6), "ts", "2 hours")
    joined = stateful.state_join(stream, "user_id", "ts", "event_id", F.col("event_type") == "view", 600)
    with stateful.rocksdb_state(t.spark):
        done = flows.materialize(joined, "append")
    return done.select(F.col("key").alias("user_id"), F.col("id").alias("click_id"), F.col("state_id").alias("view_id"), "age_us")


@query(
    "str_13_late_rows",
    "STR-13",
    sql="""WITH e AS (SELECT *, event_id % 4 AS slice, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events),
w AS (SELECT s.slice, (SELECT epoch_ms(max(ts)) - 300000 FROM e WHERE e.slice < s.slice) AS passed FROM (SELECT DISTINCT slice FROM e) s),
k AS (SELECT e.*, coalesce(epoch_ms(window_start + INTERVAL 1 HOUR) <= passed, false) AS late FROM e JOIN w USING (slice))
SELECT window_start, event_type, count(*) FILTER (WHERE NOT late)::BIGINT AS on_time, count(*) FILTER (WHERE late)::BIGINT AS late FROM k GROUP BY ALL""",
)
def late_rows(t: Tables) -> DataFrame:
    """Hourly windows of what came in time beside what came after its window was closed; together they are the input."""
    stream = flows.event_time(stateful.arriving(t.events, F.col("event_id") % 4, 4), "ts", "5 minutes")
    tagged = stateful.tagged_late(stream, "ts", 3600, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    windows, late = stateful.windows_and_late_rows(tagged, ["event_type"])
    both = windows.select("window_start", "event_type", F.col("n").alias("on_time"), F.lit(0).alias("late")).unionByName(late.select("window_start", "event_type", F.lit(0).alias("on_time"), F.lit(1).alias("late")))
    return both.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.sum("on_time").cast("long").alias("on_time"), F.sum("late").cast("long").alias("late"))


@query("str_17_lookup_join", "STR-17", "JOIN-14", "SRC-16", sql="SELECT event_id, a.n_name AS pickup, b.n_name AS dropoff FROM events JOIN nation a ON user_id % 30 = a.n_nationkey JOIN nation b ON event_id % 27 = b.n_nationkey")
def lookups(t: Tables) -> DataFrame:
    zone = lambda name: small_side(t.nation.select(F.col("n_nationkey").alias(f"{name}_key"), F.col("n_name").alias(name)))
    rides = events(t).select("event_id", (F.col("user_id") % 30).alias("p"), (F.col("event_id") % 27).alias("d"))
    named = flows.lookup_join(flows.lookup_join(rides, zone("pickup"), F.col("p") == F.col("pickup_key")), zone("dropoff"), F.col("d") == F.col("dropoff_key"))
    return flows.materialize(named.select("event_id", "pickup", "dropoff"), "append")


@query("src_16_cached_lookup", "SRC-16", "STR-17", sql="SELECT event_id, n_name AS pickup FROM events JOIN nation ON user_id % 30 = n_nationkey")
def cached_lookup(t: Tables) -> DataFrame:
    """Four micro-batches that look their zones up in one snapshot, which would be read again after an hour."""
    zones = flows.CachedLookup(lambda: t.nation.select("n_nationkey", "n_name"), 3600)
    rides = stateful.arriving(t.events.select("event_id", "user_id"), F.col("event_id") % 4, 4)
    return zones.join(rides, lambda batch: batch["user_id"] % 30 == F.col("n_nationkey"), ["event_id", "n_name"]).withColumnRenamed("n_name", "pickup")


@query("str_18_pass_through_fan_out", "STR-18", "SNK-8", "SNK-9", sql="SELECT 'raw' AS sink, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'clicks', count(*)::BIGINT FROM events WHERE event_type = 'click'")
def fan_out(t: Tables) -> DataFrame:
    """One source, two outputs, each micro-batch computed once."""
    folder, checkpoint = shared_folder(t.spark, "fan"), shared_folder(t.spark, "stream")
    stamped = events(t).select("event_id", "event_type", F.unix_millis("ts").alias("ms"))
    sinks = {"raw": lambda b: b, "clicks": lambda b: b.filter("event_type = 'click'")}
    flows.run_once(stamped, lambda batch, n: flows.fan_out(batch, n, sinks, folder), "append", checkpoint)
    counted = [t.spark.read.parquet(f"{folder}/{n}").agg(rows().alias("n")).select(F.lit(n).alias("sink"), "n") for n in sinks]
    return counted[0].union(counted[1])


@query("str_20_dedupe", "STR-20", sql="SELECT count(DISTINCT (user_id, event_type, ts))::BIGINT AS n FROM events")
def dedupe(t: Tables) -> DataFrame:
    """Publishing the same records again changes nothing."""
    once = events(t, "1 hour").select("user_id", "event_type", "ts")
    return flows.materialize(flows.dedupe_stream(once.union(once), ["user_id", "event_type", "ts"]), "append").agg(rows().alias("n"))


@query(
    "str_sliding",
    "STR-SLIDE",
    sql="""SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, event_type, count(*)::BIGINT AS n
FROM (SELECT unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS window_start, event_type FROM events) GROUP BY ALL""",
)
def sliding(t: Tables) -> DataFrame:
    return flows.materialize(flows.tumbling(events(t), "ts", "10 minutes", ["event_type"], rows().alias("n"), slide="5 minutes"))


@query("sup_9_row_consumer", "SUP-9", sql="SELECT count(*)::BIGINT AS inserted FROM events")
def row_consumer(t: Tables) -> DataFrame:
    """A consumer that inserts what arrives, a micro-batch at a time."""
    return flows.materialize(events(t).select("event_id"), "append").agg(rows().alias("inserted"))


#: Batches of the arriving stream: four slices, ten minutes apart.
FIRST_ARRIVAL, ARRIVED = "2024-06-01 00:00:00", "TIMESTAMP '2024-06-01' + INTERVAL 10 MINUTE * (event_id % 4)"


def arrivals(t: Tables, size: str, keys: list[str], partial: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """Windows over the time at which each of four batches arrives, ten minutes after the one before."""
    stream = stateful.arriving(t.events.drop("ts"), F.col("event_id") % 4, 4)
    return flows.by_arrival(stream, lambda n: F.lit(FIRST_ARRIVAL).cast("timestamp") + F.expr(f"interval {10 * n} minutes"), size, keys, partial, totals)


def arrived(size: str, keys: str, aggregates: str) -> str:
    """The batch equivalent in DuckDB."""
    at = f"time_bucket(INTERVAL '{size}', {ARRIVED})"
    return f"SELECT {at} AS window_start, {at} + INTERVAL '{size}' AS window_end, {keys}, {aggregates} FROM events GROUP BY ALL"


def mean() -> Column:
    return F.round(F.sum("total") / F.sum("n"), 6).cast("double")


@query("str_7_arrival_counts", "STR-7", sql=arrived("15 minutes", "user_id, event_type", "count(*)::BIGINT AS n, round(sum(value::DECIMAL(18,4))::DOUBLE / count(*), 6) AS mean"))
def arrival_counts(t: Tables) -> DataFrame:
    """Processing-time windows of 15 minutes by two keys: rows and mean."""
    return arrivals(t, "15 minutes", ["user_id", "event_type"], {"n": rows(), "total": exact_sum("value")}, {"n": F.sum("n"), "mean": mean()})


@query("str_8_arrival_attention", "STR-8", sql=arrived("15 minutes", "user_id", "count(*)::BIGINT AS n"))
def arrival_attention(t: Tables) -> DataFrame:
    """Processing-time windows of 15 minutes by actor: rows."""
    return arrivals(t, "15 minutes", ["user_id"], {"n": rows()}, {"n": F.sum("n")})


@query("str_9_arrival_trend", "STR-9", "STR-10", sql=arrived("30 minutes", "user_id", "round(sum(value::DECIMAL(18,4))::DOUBLE / count(*), 6) AS mean, count(*)::BIGINT AS n"))
def arrival_trend(t: Tables) -> DataFrame:
    """Processing-time windows of half an hour by actor: mean and rows."""
    return arrivals(t, "30 minutes", ["user_id"], {"n": rows(), "total": exact_sum("value")}, {"mean": mean(), "n": F.sum("n")})


@query(
    "str_11_tone_by_theme",
    "STR-11",
    sql="""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, theme, round(avg(value), 6)::DOUBLE AS avg_tone
FROM (SELECT ts, value, unnest(CASE WHEN event_id % 4 = 0 THEN [event_type] WHEN event_id % 4 = 1 THEN [event_type, 'user ' || user_id % 3] WHEN event_id % 4 = 2 THEN ['all'] ELSE [] END) AS theme FROM events) GROUP BY ALL""",
)
def tone_by_theme(t: Tables) -> DataFrame:
    """A delimited list of themes is exploded in the stream; an hour's mean tone of each."""
    turn = F.col("event_id") % 4
    listed = F.when(turn == 0, F.concat("event_type", F.lit("; "))).when(turn == 1, F.concat("event_type", F.lit("; user "), (F.col("user_id") % 3).cast("string"))).when(turn == 2, ";all; ;")
    exploded = events(t).withColumn("theme", F.explode(delimited(listed, ";")))
    return flows.materialize(flows.tumbling(exploded, "ts", "1 hour", ["theme"], F.round(F.avg("value"), 6).alias("avg_tone")))
