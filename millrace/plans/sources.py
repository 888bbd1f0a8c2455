"""Sources: what each reader makes of inputs written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import exact_sum
from millrace.operators.relational import small_side
from millrace.registry import Tables, query
from millrace.session import shared_folder
from millrace.sources import api, avro, files, schema, topics
from millrace.streaming import flows

TEXT_TYPES = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("src_1_parquet_glob", "SRC-1", "PRJ-1", sql="SELECT n_nationkey, n_name FROM nation")
def parquet_glob(t: Tables) -> DataFrame:
    return files.parquet(t.spark, f"{t.folder}/natio[n].parquet").select("n_nationkey", "n_name")


@query("src_2_csv_explicit", "SRC-2", "SRC-4", "SRC-24", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_explicit(t: Tables) -> DataFrame:
    """Compressed files with a header in a tree of folders, read by an explicit schema."""
    folder = shared_folder(t.spark, "csv")
    t.orders.write.option("header", "true").option("compression", "gzip").option("maxRecordsPerFile", 100_000).csv(f"{folder}/year=all")
    return files.csv(t.spark, [folder], TEXT_TYPES, recursive=True)


@query("src_3_csv_strings", "SRC-3", "SRC-25", sql="SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_strings(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "csv")
    t.nation.write.option("header", "true").csv(folder)
    return files.csv(t.spark, folder)


@query("src_5_partition_tree", "SRC-5", "SRC-6", "SRC-7", "SNK-2", sql="SELECT o_orderkey, year(o_orderdate)::INT AS year, o_orderstatus AS status FROM orders WHERE year(o_orderdate) IN (1994, 1996, 1997) AND o_orderstatus IN ('F', 'O')")
def partition_tree(t: Tables) -> DataFrame:
    """Wanted partitions listed as paths, the missing ones left out."""
    from millrace.sources.sinks import write_parquet

    root = shared_folder(t.spark, "tree")
    write_parquet(t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")), root, partitions=["year", "status"])
    wanted = files.partition_paths(root, year=files.year_list("1994,1996-1997"), status=["F", "O", "X"])
    found = t.spark.read.option("basePath", root).parquet(*files.existing(t.spark, wanted))
    return found.select("o_orderkey", "year", "status")


@query("src_8_tsv_positions", "SRC-8", "SRC-9", sql="SELECT event_id, user_id AS actor, value AS goldstein, 'T' || event_type AS code, -1.75::DOUBLE AS tone, 312 AS word_count FROM events")
def tsv_positions(t: Tables) -> DataFrame:
    """Lines without header or quotes; blank and short ones drop out, empty fields are null."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("\t", s("event_id"), F.lit(""), s("user_id"), F.concat(F.lit("T"), F.col("event_type")), s("value"), F.lit("-1.75,2.25,4,6.25,19.5,0.5,312"))
    lines = t.events.select(line.alias("value")).union(t.spark.createDataFrame([("",), ("1\t2",)], "value string"))
    wide = files.tsv_by_position(lines, {"event_id": (0, "long"), "none": (1, "int"), "actor": (2, "long"), "code": (3, "string"), "goldstein": (4, "double"), "raw": (5, "string")})
    tone = files.split_tone(F.col("raw"))
    return wide.filter("none is null").select("event_id", "actor", "goldstein", "code", tone["tone"].alias("tone"), tone["word_count"].alias("word_count"))


EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])


@query("src_11_json_messages", "SRC-11", "SNK-18", sql="SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 0")
def json_messages(t: Tables) -> DataFrame:
    """JSON messages as a stream of files; every tenth record is broken and ignored."""
    folder = shared_folder(t.spark, "messages")
    messages = topics.as_messages(t.events.select("event_id", "user_id", "event_type"), F.col("event_id"))
    broken = F.when(F.col("key").cast("long") % 10 == 0, F.lit('{"event_id": oops')).otherwise(F.col("value"))
    messages.withColumn("value", broken).write.parquet(folder)
    return flows.materialize(topics.json_records(flows.file_stream(t.spark, folder), EVENT), "append")


@query("src_15_registry_header", "SRC-15", sql="SELECT event_id, 0 AS magic, (event_id % 70000)::INT AS schema_id, 'rec' || event_id AS payload FROM events")
def registry_header(t: Tables) -> DataFrame:
    number = F.unhex(F.lpad(F.hex(F.col("event_id") % 70000), 8, "0"))
    wire = t.events.select("event_id", F.concat(F.unhex(F.lit("00")), number, F.concat(F.lit("rec"), F.col("event_id").cast("string")).cast("binary")).alias("value"))
    return wire.select("event_id", topics.registry_header(F.col("value")).alias("h")).select("event_id", "h.magic", "h.schema_id", F.col("h.payload").cast("string").alias("payload"))


RIDE_1 = """{"type": "record", "name": "Ride", "namespace": "rides", "fields": [
  {"name": "event_id", "type": "long"}, {"name": "kind", "type": "string"}, {"name": "user_id", "type": "int"},
  {"name": "amount", "type": ["null", "float"]}, {"name": "dropped", "type": {"type": "array", "items": "string"}}]}"""
RIDE_2 = """{"type": "record", "name": "Ride", "namespace": "rides", "fields": [
  {"name": "user_id", "type": "long"}, {"name": "event_id", "type": "long"}, {"name": "event_type", "type": "string", "aliases": ["kind"]},
  {"name": "amount", "type": ["double", "null"]}, {"name": "note", "type": "string", "default": "none"},
  {"name": "stamp", "type": {"type": "long", "logicalType": "timestamp-micros"}, "default": -1}]}"""


@query(
    "src_15_avro_records",
    "SRC-15",
    sql="""SELECT user_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN round(value)::FLOAT::DOUBLE ELSE value END AS amount,
  CASE WHEN event_id % 2 = 0 THEN 'none' ELSE 'é' || props END AS note, CASE WHEN event_id % 2 = 0 THEN -1 ELSE epoch_us(ts) END AS stamp FROM events""",
)
def avro_records(t: Tables) -> DataFrame:
    """Messages of two schema versions on one topic, read by the newer one: renamed, widened, added and dropped fields."""
    old, new = t.events.filter("event_id % 2 = 0"), t.events.filter("event_id % 2 <> 0")
    old = old.select("event_id", F.col("event_type").alias("kind"), F.col("user_id").cast("int").alias("user_id"), F.round("value").cast("float").alias("amount"), F.array("event_type", "props").alias("dropped"))
    new = new.select("user_id", "event_id", "event_type", F.col("value").alias("amount"), F.concat(F.lit("é"), "props").alias("note"), F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"))
    topic = avro.avro_messages(old, RIDE_1, 7).unionByName(avro.avro_messages(new, RIDE_2, 300))
    return avro.avro_records(topic, {7: RIDE_1, 300: RIDE_2}, RIDE_2)


@query("src_16_lookup_table", "SRC-16", "JOIN-14", sql="SELECT event_id, n_name AS zone FROM events JOIN nation ON user_id % 30 = n_nationkey")
def lookup_table(t: Tables) -> DataFrame:
    """A dimension read once and broadcast; rows without a match drop out."""
    from millrace.streaming.flows import lookup_join

    rides = t.events.select("event_id", (F.col("user_id") % 30).alias("zone_id"))
    return lookup_join(rides, small_side(t.nation.select("n_nationkey", F.col("n_name").alias("zone"))), F.col("zone_id") == F.col("n_nationkey")).select("event_id", "zone")


@query("src_17_json_documents", "SRC-17", sql="SELECT c_mktsegment AS brand, round(avg(c_acctbal), 2)::DOUBLE AS avg_price FROM customer GROUP BY 1")
def json_documents(t: Tables) -> DataFrame:
    """Files that each hold one array of objects over many lines; types are found in the data."""
    folder = shared_folder(t.spark, "json")
    listed = t.customer.groupBy("c_mktsegment").agg(F.collect_list(F.struct("c_mktsegment", "c_acctbal")).alias("own"))
    arrays = listed.select(F.replace(F.to_json("own"), F.lit("},{"), F.lit("},\n {")).alias("value"), F.col("c_mktsegment").alias("file"))
    arrays.write.partitionBy("file").text(folder)
    read = files.json_documents(t.spark, folder)
    return read.groupBy(F.col("c_mktsegment").alias("brand")).agg(F.round(F.avg("c_acctbal"), 2).alias("avg_price"))


@query("src_18_csv_to_parquet", "SRC-18", "SNK-1", sql="SELECT s_suppkey::BIGINT AS s_suppkey, s_name FROM supplier")
def csv_to_parquet(t: Tables) -> DataFrame:
    from millrace.sources.sinks import write_parquet

    folder = shared_folder(t.spark, "convert")
    t.supplier.select("s_suppkey", "s_name").write.option("header", "true").csv(f"{folder}/in")
    write_parquet(files.csv(t.spark, f"{folder}/in", infer=True), f"{folder}/out")
    return t.spark.read.parquet(f"{folder}/out").withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("src_19_union_by_name", "SRC-19", sql="SELECT r_regionkey, r_name, NULL::INT AS extra FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_by_name(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "merge")
    t.region.write.parquet(f"{folder}/part=1")
    t.nation.select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"), F.col("n_regionkey").alias("extra")).write.parquet(f"{folder}/part=2")
    return files.parquet(t.spark, folder, merge_schema=True).select("r_regionkey", "r_name", "extra")


@query("src_20_external_table", "SRC-20", sql="SELECT p_partkey, p_brand FROM part")
def external_table(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "external")
    t.part.select("p_partkey", "p_brand", F.lit("surplus").alias("z")).write.option("header", "true").csv(folder)
    return files.external_csv(t.spark, "millrace_external", folder, "p_partkey bigint, p_brand string")


@query(
    "src_23_nested_bodies",
    "SRC-23",
    "SUP-14",
    sql="""SELECT 'O' || o_orderstatus AS indicator_code, n_name AS country_iso3, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4 AND year(o_orderdate) <> 1995 GROUP BY ALL""",
)
def nested_bodies(t: Tables) -> DataFrame:
    """A JSON body a nation, [meta, records], to typed rows: error bodies give none, bad years and nameless countries drop out."""
    customers = t.customer.join(small_side(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_name")
    yearly = t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_nationkey", "n_name", F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("y")).agg(exact_sum("o_totalprice").alias("value"))
    date = F.when(F.col("y") == 1995, "n/a").otherwise(F.col("y").cast("string"))
    named = F.struct(F.col("n_name").alias("value")).alias("country")
    record = lambda iso: F.struct(F.struct(F.concat(F.lit("O"), "status").alias("id")).alias("indicator"), iso.alias("countryiso3code"), named, date.alias("date"), "value", F.lit("").alias("unit"), F.lit("").alias("obs_status"))
    records = yearly.select("n_nationkey", F.explode(F.array(record(F.col("n_name")), record(F.lit("")))).alias("r"))
    listed = F.to_json(F.collect_list("r"), {"ignoreNullFields": "false"})
    body = F.when(F.col("n_nationkey") % 5 == 4, '[{"message":[{"id":"175","value":"archived"}]}]').otherwise(F.concat(F.lit('[{"page":1,"pages":1},'), F.col("listed"), F.lit("]")))
    bodies = records.groupBy("n_nationkey").agg(listed.alias("listed")).select(body.alias("body"))
    return api.indicator_rows(bodies).select("indicator_code", "country_iso3", "year", "value")


CODE_SEED = "SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 5 THEN '  ' ELSE ' ' || lower(left(n_name, 2)) || ' ' END AS iso2, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE lower(left(n_name, 3)) END AS iso3 FROM nation"


@query(
    "src_26_code_map",
    "SRC-26",
    sql=f"""WITH m AS (SELECT upper(trim(iso2)) AS iso2, arg_max(upper(trim(iso3)), n_nationkey) AS iso3 FROM ({CODE_SEED}) WHERE trim(iso2) <> '' AND trim(coalesce(iso3, '')) <> '' GROUP BY 1)
SELECT s_suppkey, iso3 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN m ON upper(left(n_name, 2)) = iso2""",
)
def mapped_codes(t: Tables) -> DataFrame:
    """Codes mapped by a seed file's table; blanks drop out, of equal codes the last counts."""
    key = F.col("n_nationkey")
    seed = t.nation.select(
        "n_nationkey",
        F.when(key % 6 == 5, "  ").otherwise(F.concat(F.lit(" "), F.lower(F.left("n_name", F.lit(2))), F.lit(" "))).alias("iso2"),
        F.when(key % 7 != 3, F.lower(F.left("n_name", F.lit(3)))).alias("iso3"),
    )
    codes = schema.code_map(seed, "iso2", "iso3", order="n_nationkey")
    named = t.supplier.join(small_side(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("s_suppkey", F.upper(F.left("n_name", F.lit(2))).alias("iso2")).join(small_side(codes), "iso2").select("s_suppkey", "iso3")


@query(
    "sup_15_polled_totals",
    "SUP-15",
    sql="""WITH l AS (SELECT n_name AS country, c_acctbal AS value, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT country, count(*)::BIGINT AS polled, count(*) FILTER (WHERE value > 0)::BIGINT AS published, count(*) FILTER (WHERE NOT coalesce(value > 0, false))::BIGINT AS skipped FROM l WHERE nth <= 8 GROUP BY 1""",
)
def polled_totals(t: Tables) -> DataFrame:
    """Of each country the first locations up to a cap; what was published and what was skipped."""
    located = t.customer.join(small_side(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"), F.col("c_acctbal").alias("value"))
    return api.poll_totals(located, "country", "c_custkey", F.col("value") > 0, cap=8)


@query(
    "src_28_slots",
    "SRC-28",
    sql="""WITH s AS (SELECT unnest(generate_series((SELECT time_bucket(INTERVAL 15 MINUTE, min(ts)) FROM events), (SELECT time_bucket(INTERVAL 15 MINUTE, max(ts)) FROM events), INTERVAL 15 MINUTE)) AS slot)
SELECT slot, count(event_id)::BIGINT AS n FROM s LEFT JOIN events ON time_bucket(INTERVAL 15 MINUTE, ts) = slot GROUP BY 1""",
)
def slots(t: Tables) -> DataFrame:
    """Every quarter of an hour from the first event to the last, those without events too."""
    quarter = F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"]
    counted = t.events.groupBy(quarter.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ends = counted.agg(F.min("at").cast("string").alias("first"), F.max("at").cast("string").alias("last")).first()
    series = files.slots(t.spark, ends["first"], ends["last"]) if ends["first"] else t.spark.createDataFrame([], "slot timestamp")
    return series.join(counted, F.col("slot") == F.col("at"), "left").select(F.col("slot").cast("timestamp_ntz").alias("slot"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("schema_aliases", "SCHEMA-ALIAS", sql="SELECT c_custkey AS location_id, c_name AS location, c_acctbal AS value FROM customer")
def aliases(t: Tables) -> DataFrame:
    renamed = t.customer.withColumnsRenamed({"c_custkey": "LocationID", "c_acctbal": "VALUE"})
    return schema.resolve_aliases(renamed, {"location_id": ("location_id", "locationid"), "location": ("location", "c_name"), "value": ("value", "reading")})


@query("schema_nested_children", "SCHEMA-NESTED", "JOIN-11", "SNK-12", sql="SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS list_idx, l_partkey AS product FROM lineitem")
def nested_children(t: Tables) -> DataFrame:
    """Nested orders become parent and child tables that join by generated ids."""
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items")).select(F.col("l_orderkey").alias("Order ID"), "items")
    tables = schema.parent_and_children(nested, "orders", "load-1", ["order_id"])
    child = tables["orders__items"].join(tables["orders"].select(F.col("_dlt_id").alias("_p"), "order_id"), F.col("_dlt_parent_id") == F.col("_p"))
    return child.select("order_id", F.col("_dlt_list_idx").alias("list_idx"), F.col("l_partkey").alias("product"))


@query("schema_evolution", "SCHEMA-EVOLVE", "DQ-13", sql="""SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS n_regionkey, CASE WHEN n_regionkey = 1 THEN 'one' END AS n_regionkey__v_string, NULL::VARCHAR AS note, n_name FROM nation""")
def evolution(t: Tables) -> DataFrame:
    """A value that does not fit goes to a variant column, a new column is added, a missing one is null."""
    old = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_regionkey", T.IntegerType()), T.StructField("note", T.StringType())])
    new = t.nation.select("n_nationkey", F.when(F.col("n_regionkey") == 1, "one").otherwise(F.col("n_regionkey").cast("string")).alias("n_regionkey"), "n_name")
    return schema.evolve(old, new)
