"""Operators on small literal frames: given rows, expected rows."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.testing import assertDataFrameEqual

from millrace.functions import markup
from millrace.functions import scalars as S
from millrace.operators import checks as C
from millrace.operators import relational as R
from millrace.operators import scans
from millrace.operators.search import BooleanQuery
from millrace.sources import api, files, schema, sinks, topics
from millrace.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- scalars ---------------------------------------------------------------------------


def test_minute_boundaries_are_counted(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, S.minutes_between(ts("2024-01-01 00:00:59"), ts("2024-01-01 00:02:00"))) == 2


@pytest.mark.parametrize(
    ("title", "want"),
    [("IV. ANUNCIOS", "Anuncios"), ("III.- OTRAS RESOLUCIONES DE LA CONSEJERIA", "Otras Resoluciones de la Consejeria"), ("la casa", "La Casa"), ("", ""), ("I. SOBRE EL AGUA", "Sobre el Agua"), ("I. II.- A Y E", "A y E"), ("III.", "III."), (None, None)],
)
def test_section_title(spark, title, want):
    assert one(spark, S.section_title(F.lit(title).cast("string"))) == want


def test_initcap_restarts_after_any_mark(spark):
    assert one(spark, S.initcap_words(F.lit("o'neil-SMITH x2y"))) == "O'Neil-Smith X2y"


@pytest.mark.parametrize(("text", "want"), [("Lunes, 5 de Enero de 2024.", "2024-01-05"), ("31 de diciembre de 1999", "1999-12-31"), ("1 de setiembre de 2001", "2001-09-01"), ("no date", None)])
def test_spanish_date(spark, text, want):
    assert one(spark, S.spanish_date(F.lit(text))) == want


def test_respaced(spark):
    for glued, want in (("ComercioExterior", "Comercio Exterior"), ("VI.Avisos", "VI. Avisos"), ("Gerencia Forestalde Montaña", "Gerencia Forestal de Montaña"), ("3,b ley5 III.a", "3,b ley5 III.a")):
        assert one(spark, S.respaced(F.lit(glued))) == want


@pytest.mark.parametrize(("text", "want"), [("a; b;;", ["a", "b"]), (None, []), (" ", [])])
def test_delimited(spark, text, want):
    assert one(spark, S.delimited(F.lit(text).cast("string"), ";")) == want


def test_row_id_takes_nulls_as_empty(spark):
    assert one(spark, S.row_id(F.lit("a"), F.lit(None).cast("string"), F.lit(1))) == one(spark, F.md5(F.lit("a1")))


# --- relational ----------------------------------------------------------------------------


def test_row_comparison_drops_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (0, 9), (1, 2)], "a int, b int")
    assert sorted((r.a, r.b) for r in df.filter(R.row_before(["a", "b"], [F.lit(1), F.lit(2)])).collect()) == [(0, 9), (1, 1)]


def test_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(y, n) for y in range(4) for n in range(5)], "y int, n int")
    first = R.keyset_page(df, ["y", "n"], 7).collect()
    second = R.keyset_page(df, ["y", "n"], 7, (first[6].y, first[6].n)).collect()
    assert len(first) == 8 and (second[0].y, second[0].n) == (first[7].y, first[7].n)


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for merge, want in ((R.upsert, [(1, "a"), (2, "c"), (3, "d")]), (R.insert_only, [(1, "a"), (2, "b"), (3, "d")])):
        once = merge(old, new, ["k"])
        assertDataFrameEqual(once, spark.createDataFrame(want, old.schema))
        assertDataFrameEqual(merge(once, new, ["k"]), once)
    assertDataFrameEqual(R.delete_insert(old, new, ["k"]), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], old.schema))


def test_either_key_join_offers_equal_candidates_once(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "aid int")
    games = spark.createDataFrame([(1, 2, "w"), (1, 1, "d")], "white int, black int, result string")
    got = R.either_key_join(left, games, "aid", ["white", "black"]).collect()
    assert sorted((r.aid, r.result or "") for r in got) == [(1, "d"), (1, "w"), (2, "w"), (3, "")]


def test_decode_fragments(spark):
    dictionary = spark.createDataFrame([("USA", "United States", "country", 1), ("GOV", "Government", "role", 2), ("GOV", "Ignored", "role", None), ("USAGOV", "US Government", "known", 1)], "code string, label string, kind string, priority int")
    codes = spark.createDataFrame([("USAGOV",), ("USABBB",), ("USAX",), ("GOV",), ("",), (None,), ("USABBB",)], "c string")
    got = {r.code: (r.label, r.parts) for r in R.decode_fragments(codes, "c", dictionary).collect()}
    assert {c: v[0] for c, v in got.items()} == {"USAGOV": "US Government", "USABBB": "United States · [BBB]", "USAX": "[USAX]", "GOV": "Government"}
    assert '"fragment":"BBB","kind":null,"label":null' in got["USABBB"][1]


def test_sessions_merge_a_gap_of_exactly_the_limit(spark):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("z", base + dt.timedelta(seconds=s)) for s in (0, 299, 599, 900)]
    got = scans.sessions(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 300).groupBy("session").count().collect()
    assert sorted(r["count"] for r in got) == [1, 3]
    native = flows.session(spark.createDataFrame(rows, "k string, ts timestamp"), "ts", "5 minutes", ["k"], F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r.n for r in native) == [1, 3]


# --- sources -------------------------------------------------------------------------------


def test_tsv_by_position(spark):
    lines = spark.createDataFrame([("1\t\t2.5",), ("",), ("short",), ("7\tx\t",)], "value string")
    got = files.tsv_by_position(lines, {"id": (0, "long"), "name": (1, "string"), "v": (2, "double")}).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(1, None, 2.5), (7, "x", None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.tsv_by_position(spark.createDataFrame([("bad\t\t",)], "value string"), {"id": (0, "long"), "v": (2, "double")}).collect()


@pytest.mark.parametrize(("tone", "want"), [("-1.75,2.25,4,6.25,19.5,0.5,312", (-1.75, 2.25, 4.0, 312)), ("", (None,) * 4), ("1.5,,2", (1.5, None, 2.0, None)), (None, (None,) * 4)])
def test_split_tone(spark, tone, want):
    assert tuple(one(spark, files.split_tone(F.lit(tone).cast("string")))) == want


def test_year_list():
    assert files.year_list("2020, 2022-2023,2020") == [2020, 2022, 2023]
    for bad in ("2023-2020", ""):
        with pytest.raises(ValueError):
            files.year_list(bad)


def test_partition_paths():
    assert files.partition_paths("s3a://b/", location=[1], year=[2020, 2021]) == ["s3a://b/location=1/year=2020", "s3a://b/location=1/year=2021"]
    with pytest.raises(ValueError):
        files.partition_paths("x", year=[])


def test_zip_members(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.tsv", b"ok\xff")
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    row = files.zip_members(spark, f"file://{tmp_path}/*.zip").first()
    assert (row.member, row.text) == ("a.tsv", "ok\ufffd")


def test_slots_must_be_aligned(spark):
    assert files.slots(spark, "2024-01-01 00:00:00", "2024-01-01 01:00:00").count() == 5
    with pytest.raises(Exception, match="aligned"):
        files.slots(spark, "2024-01-01 00:01:00", "2024-01-01 01:00:00").collect()


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2)], "Location_ID int, Value int")
    assert schema.resolve_aliases(df, {"id": ("locationid", "location_id"), "v": ("value",)}).columns == ["id", "v"]
    with pytest.raises(ValueError, match="a, b"):
        schema.resolve_aliases(df, {"b": ("x",), "a": ("y",)})


@pytest.mark.parametrize(("name", "want"), [("First Name!", "first_name"), ("2nd", "_2nd"), ("a--b__c", "a_b_c"), ("!!", "_")])
def test_normalized_name(name, want):
    assert schema.normalized_name(name) == want


def test_contract_modes(spark):
    old = T.StructType([T.StructField("a", T.IntegerType())])
    df = spark.createDataFrame([("1", None), ("x", None), ("2", 5)], "a string, b int")
    assert sorted(str(tuple(r)) for r in schema.evolve(old, df, "evolve").collect()) == ["(1, None, None)", "(2, None, 5)", "(None, 'x', None)"]
    assert sorted(str(r.a) for r in schema.evolve(old, df, "discard_value").collect()) == ["1", "2", "None"]
    assert [r.a for r in schema.evolve(old, df, "discard_row").collect()] == [1]
    with pytest.raises(ValueError):
        schema.evolve(old, df, "freeze")


def test_indicator_pages(spark):
    bodies = spark.createDataFrame([(1, '[{"page":1},[{"indicator":{"id":"I"},"countryiso3code":"ESP","country":{"value":"Spain"},"date":"2020","value":null,"obs_status":""}]]'), (2, '[{"message":"gone"}]')], "page int, body string")
    row = api.indicator_rows(bodies).collect()
    assert [(r.indicator_code, r.country_iso3, r.year, r.value, r.obs_status) for r in row] == [("I", "ESP", 2020, None, None)]


def test_a_second_page_of_records_raises(spark):
    many = spark.createDataFrame([(1, json.dumps([{"page": 1, "pages": 2}, []]))], "page int, body string")
    with pytest.raises(Exception, match="more than one page"):
        api.indicator_rows(many).collect()


def test_code_map_of_blanks_raises(spark):
    with pytest.raises(ValueError, match="iso2"):
        schema.code_map(spark.createDataFrame([(1, " ", "x"), (2, "es", None)], "n int, iso2 string, iso3 string"), "iso2", "iso3", order="n")


def test_rewrite_recovers(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    sinks.rewrite(spark.range(3), path)
    (tmp_path / "table").rename(tmp_path / "table.former")  # a crash between the two moves
    sinks.merge_into(path, spark.range(3, 5), "append")
    assert spark.read.parquet(path).count() == 5


def test_merge_keys_compare_null_safe(spark):
    old = spark.createDataFrame([(None, "a", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(None, "c", 3), (None, "b", 2), (4, "x", 1), (4, "y", 2)], "k int, v string, at int")
    once = R.upsert(old, new, ["k"], ["at"])
    assert sorted(map(tuple, once.collect()), key=str) == [(4, "y", 2), (None, "c", 3)]
    assert R.insert_only(R.insert_only(old, new, ["k"]), new, ["k"]).count() == 2


def test_start_modes():
    assert topics.start_options("group") == {}
    with pytest.raises(ValueError):
        topics.start_options("offsets")


# --- checks, search, markup ------------------------------------------------------------------


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, None, -1), (None, "z", 0)], "k int, s string, v int")
    assert C.not_null(df, "s").count() == 1
    assert [r.k for r in C.unique(df, "k").collect()] == [1]
    assert C.accepted_values(df, "s", ["a"]).count() == 1
    assert C.positive(df, "v").count() == 2 and C.non_negative(df, "v").count() == 1
    assert C.column_count_between(df, 1, 3)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (BooleanQuery.of_words("ayuda vivienda"), "ayuda:* & vivienda:*"),
        (BooleanQuery.of_words("  !! "), ""),
        (BooleanQuery((("a", "b c"), ("d",)), ("e", "f g")), "(a:* | (b:* & c:*)) & d:* & !e:* & !(f:* & g:*)"),
    ],
)
def test_query_text(query, want):
    assert query.as_text() == want


def test_anchors_and_markdown():
    html = '<head><title>x</title></head><a href="/b">One <b>two</b></a><a name="n">no</a><a href="http://o.org/">O</a><h2>Head</h2><ul><li>i</li></ul><script>s()</script><p>a <em>b</em></p>'
    assert markup.anchors_of(html, "http://h.es/a/") == [{"href": "http://h.es/b", "label": "One two"}, {"href": "http://o.org/", "label": "O"}]
    assert markup.markdown_of(html).splitlines()[-3:] == ["## Head", "- i", "a *b*"]
    assert markup.anchors_of(None) == [] and markup.markdown_of(None) == ""


def test_stream_drops_what_comes_after_the_watermark(spark, tmp_path):
    """Two micro-batches: the second holds a row older than the watermark."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m, tzinfo=dt.timezone.utc)
    folder = f"{tmp_path}/in"
    for i, minutes in enumerate(([0, 30], [1, 31], [59])):
        spark.createDataFrame([(at(m),) for m in minutes], "ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        if i == 0:
            schema_of = spark.read.parquet(folder).schema
        stream = spark.readStream.schema(schema_of).option("maxFilesPerTrigger", 1).parquet(folder)
        windows = flows.tumbling(flows.event_time(stream, "ts", "5 seconds"), "ts", "5 minutes", [], F.count(F.lit(1)).alias("n"))
        flows.run_once(windows, lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out"), "append", f"{tmp_path}/checkpoint")
    got = {r.window_start.minute: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 1, 30: 2}


def test_approximate_distinct_is_close(spark, sf):
    from millrace.catalog import QUERIES

    exact = QUERIES["agg_8_count_distinct"](spark, sf).first().parts
    assert abs(QUERIES["agg_10_approx_distinct"](spark, sf).first().parts_estimate - exact) <= 0.05 * exact
