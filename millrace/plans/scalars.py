"""Scalar functions, one query a group of the survey's section 2.9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.registry import Tables, query


@query(
    "fn_string",
    "FN-STRING",
    sql="""SELECT p_partkey, lpad(p_partkey::VARCHAR, 14, '0') AS padded, replace(replace(p_name, 'a', 'A'), 'e', 'E') AS replaced,
  upper(p_brand) AS up, lower(p_brand) AS low, trim(p_type) AS trimmed, substring(p_name, 2, 3) AS piece, length(p_name)::INT AS len,
  p_brand || '/' || p_type AS joined, left(p_name, 4) AS head FROM part""",
)
def string(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.lpad(F.col("p_partkey").cast("string"), 14, "0").alias("padded"),
        F.replace(F.replace("p_name", F.lit("a"), F.lit("A")), F.lit("e"), F.lit("E")).alias("replaced"),
        F.upper("p_brand").alias("up"),
        F.lower("p_brand").alias("low"),
        F.trim("p_type").alias("trimmed"),
        F.substring("p_name", 2, 3).alias("piece"),
        F.length("p_name").alias("len"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("joined"),
        F.left("p_name", F.lit(4)).alias("head"),
    )


@query("fn_regex", "FN-REGEX", sql="SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS masked, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS number, regexp_matches(p_type, '^[A-M]') AS early FROM part")
def regex(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_replace("p_name", "[aeiou]+", "_").alias("masked"), F.nullif(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("")).alias("number"), F.col("p_type").rlike("^[A-M]").alias("early"))


@query("fn_arrays", "FN-ARRAY", sql="SELECT p_partkey, array_to_string(list_append(string_split(p_name, ' '), 'end'), '-') AS joined, len(string_split(p_name, ' '))::INT AS n, string_split(p_name, ' ')[1] AS first, list_contains(string_split(p_name, ' '), 'red') AS has_red FROM part")
def arrays(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_join(F.array_append(words, "end"), "-").alias("joined"), F.size(words).alias("n"), F.get(words, F.lit(0)).alias("first"), F.array_contains(words, "red").alias("has_red"))


@query(
    "fn_row_id",
    "FN-HASH",
    sql="""SELECT l_orderkey, l_linenumber, md5(concat(coalesce(l_orderkey::VARCHAR, ''), coalesce(l_linenumber::VARCHAR, ''), coalesce(l_returnflag, ''), coalesce(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), ''))) AS unique_row_id FROM lineitem""",
)
def hashed(t: Tables) -> DataFrame:
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return t.lineitem.select("l_orderkey", "l_linenumber", S.row_id("l_orderkey", "l_linenumber", "l_returnflag", stamp).alias("unique_row_id"))


@query(
    "fn_dates",
    "FN-DATE",
    sql="""SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('month', ts)::TIMESTAMP AS month, year(ts)::INT AS year, hour(ts)::INT AS hour_of_day,
  ts::DATE AS day, strftime(ts, '%Y%m%d') AS compact, date_diff('minute', TIMESTAMP '2024-01-01 00:00:59', ts)::BIGINT AS minutes,
  (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS next_month FROM events""",
)
def dates(t: Tables) -> DataFrame:
    month = F.date_trunc("month", "ts")
    return t.events.select(
        "event_id",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        month.cast("timestamp_ntz").alias("month"),
        F.year("ts").alias("year"),
        F.hour("ts").alias("hour_of_day"),
        F.to_date("ts").alias("day"),
        F.date_format("ts", "yyyyMMdd").alias("compact"),
        S.minutes_between(F.lit("2024-01-01 00:00:59").cast("timestamp_ntz"), F.col("ts")).alias("minutes"),
        F.add_months(F.to_date(month), 1).cast("timestamp_ntz").alias("next_month"),
    )


@query(
    "fn_parse_stamps",
    "FN-DATE",
    sql="""SELECT event_id, date_trunc('second', ts) AS from_compact, date_trunc('second', ts) AS from_iso, date_trunc('second', ts) AS from_zoned, date_trunc('millisecond', ts) AS from_millis, NULL::TIMESTAMP AS from_junk FROM events""",
)
def parse_stamps(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    ntz = lambda c: c.cast("timestamp_ntz")
    return t.events.select(
        "event_id",
        ntz(S.from_compact_stamp(F.date_format(ts, "yyyyMMddHHmmss").cast("long"))).alias("from_compact"),
        ntz(S.from_iso_utc(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("from_iso"),
        ntz(S.from_zoned_text(F.concat(F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))).alias("from_zoned"),
        ntz(F.timestamp_millis(F.unix_millis(ts))).alias("from_millis"),
        ntz(S.from_zoned_text(F.lit("not a date"))).alias("from_junk"),
    )


@query("fn_math", "FN-MATH", sql="SELECT event_id, round(value, 2)::DOUBLE AS rounded, round(ln(abs(value) + 1), 8)::DOUBLE AS log, (event_id // 7)::BIGINT AS whole, (event_id % 7)::BIGINT AS rest, abs(value) AS magnitude FROM events")
def math(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round("value", 2).alias("rounded"), F.round(F.ln(F.abs("value") + 1), 8).alias("log"), F.expr("event_id div 7").alias("whole"), (F.col("event_id") % 7).alias("rest"), F.abs("value").alias("magnitude"))


@query("fn_conditional", "FN-COND", sql="SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS size, coalesce(nullif(o_orderstatus, 'P'), nullif(o_orderpriority, ''), '-') AS filled, round(o_totalprice / nullif(o_custkey % 3, 0), 4)::DOUBLE AS ratio FROM orders")
def conditional(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(price > 150000, "high").when(price > 50000, "mid").otherwise("low").alias("size"),
        S.first_filled(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority", F.lit("-")).alias("filled"),
        F.round(S.safe_ratio(price, F.col("o_custkey") % 3), 4).alias("ratio"),
    )


@query("fn_json", "FN-JSON", "SRC-23", sql="SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"id\":' || event_id || ',\"none\":null}' AS built FROM events")
def json(t: Tables) -> DataFrame:
    built = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), built.alias("built"))


@query("fn_json_odd_key", "FN-JSON", sql="SELECT event_id, 'u' || user_id AS id FROM events")
def json_odd_key(t: Tables) -> DataFrame:
    """A key with an at sign."""
    record = F.concat(F.lit('{"@id":"u'), F.col("user_id").cast("string"), F.lit('"}'))
    return t.events.select("event_id", F.get_json_object(record, "$.@id").alias("id"))


@query("fn_initcap", "FN-STRING", sql=r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || '-' || p_brand || ' o''x'), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)', 1), lambda x: upper(x[1]) || x[2:]), '') AS title FROM part""")
def initcap(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.initcap_words(F.concat("p_name", F.lit("-"), "p_brand", F.lit(" o'x"))).alias("title"))


@query(
    "udf_4_section_title",
    "UDF-4",
    "TXT-13",
    sql=r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'IV. ' WHEN 1 THEN 'III.- ' WHEN 2 THEN 'II. IX.-' ELSE '' END
    || CASE p_partkey % 5 WHEN 4 THEN 'III.' ELSE upper(p_name) || ' DE LA  ' || upper(p_type) || ' E Y EL AGUA' END AS raw FROM part),
  b AS (SELECT *, trim(regexp_replace(raw, '^([IVXLC]+[.\-]+\s*)+', '')) AS bare FROM s)
SELECT p_partkey, CASE WHEN bare = '' THEN raw ELSE array_to_string(list_transform(string_split_regex(bare, '\s+'),
  lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('de','del','la','las','los','y','el','en') THEN lower(w) ELSE upper(lower(w)[1]) || lower(w)[2:] END), ' ') END AS title FROM b""",
)
def section_title(t: Tables) -> DataFrame:
    numbering = F.get(F.array(*map(F.lit, ("IV. ", "III.- ", "II. IX.-", "", ""))), (F.col("p_partkey") % 5).cast("int"))
    named = F.concat(F.upper("p_name"), F.lit(" DE LA  "), F.upper("p_type"), F.lit(" E Y EL AGUA"))
    raw = F.concat(numbering, F.when(F.col("p_partkey") % 5 == 4, "III.").otherwise(named))
    return t.part.select("p_partkey", S.section_title(raw).alias("title"))


@query("sup_3_date_in_title", "SUP-3", "FN-DATE", sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_in_title(t: Tables) -> DataFrame:
    """A Spanish long date found in a title."""
    months = F.array(*(F.when(F.col("o_orderkey") % 2 == 0, "setiembre").otherwise(m) if m == "septiembre" else F.lit(m) for m in S.SPANISH_MONTHS))
    title = F.concat(F.lit("Boletin del "), F.day("o_orderdate").cast("string"), F.lit(" de "), F.get(months, F.month("o_orderdate") - 1), F.lit(" de "), F.year("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", S.spanish_date(title).alias("iso"))


@query("sup_6_respaced", "SUP-6", sql="""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'VI. Avisos ' || c_mktsegment WHEN 1 THEN 'Gerencia Forestal de ' || c_mktsegment ELSE 'Comercio Exterior 3,b ley5 ' || c_mktsegment END AS text FROM customer""")
def respaced(t: Tables) -> DataFrame:
    glued = F.get(F.array(*map(F.lit, ("VI.Avisos ", "Gerencia Forestalde ", "ComercioExterior 3,b ley5 "))), (F.col("c_custkey") % 3).cast("int"))
    return t.customer.select("c_custkey", S.respaced(F.concat(glued, F.col("c_mktsegment"))).alias("text"))
