"""Avro records: bytes as the format has them, resolution between schemas, errors."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.sources import avro

WRITER = {
    "type": "record",
    "name": "Trip",
    "fields": [
        {"name": "id", "type": "int"},
        {"name": "city", "type": ["null", "string"]},
        {"name": "fare", "type": "float"},
        {"name": "tags", "type": {"type": "array", "items": {"type": "record", "name": "Tag", "fields": [{"name": "k", "type": "string"}, {"name": "n", "type": ["long", "null"]}]}}},
        {"name": "extra", "type": {"type": "map", "values": "boolean"}},
        {"name": "state", "type": {"type": "enum", "name": "State", "symbols": ["OPEN", "DONE"]}},
        {"name": "code", "type": {"type": "fixed", "name": "Code", "size": 2}},
        {"name": "raw", "type": "bytes"},
        {"name": "first", "type": ["null", "Tag"]},
    ],
}
READER = {
    "type": "record",
    "name": "Journey",
    "aliases": ["Trip"],
    "fields": [
        {"name": "key", "type": "double", "aliases": ["id"]},
        {"name": "city", "type": ["null", "string"]},
        {"name": "added", "type": ["null", "int"], "default": None},
        {"name": "tags", "type": {"type": "array", "items": {"type": "record", "name": "Tag", "fields": [{"name": "n", "type": ["null", "double"]}]}}},
        {"name": "state", "type": {"type": "enum", "name": "State", "symbols": ["DONE", "OTHER"], "default": "OTHER"}},
        {"name": "raw", "type": "string"},
    ],
}
ROW = {"id": -3, "city": "Ávila", "fare": 1.5, "tags": [{"k": "a", "n": 1}, {"k": "", "n": None}], "extra": {"x": True}, "state": "OPEN", "code": b"ab", "raw": b"hi", "first": {"k": "z", "n": 2**40}}


def encoded(schema, row) -> bytes:
    out = bytearray()
    avro.encoder(avro.parsed(json.dumps(schema)))(row, out)
    return bytes(out)


def decoded(data: bytes, writer, reader):
    row, end = avro.decoder(avro.parsed(json.dumps(writer)), avro.parsed(json.dumps(reader)))(data, 0)
    assert end == len(data)
    return row


@pytest.mark.parametrize(("number", "raw"), [(0, "00"), (-1, "01"), (1, "02"), (-64, "7f"), (64, "8001"), (2**63 - 1, "feffffffffffffffff01"), (-(2**63), "ffffffffffffffffff01")])
def test_zig_zag_numbers(number, raw):
    out = bytearray()
    avro.write_long(number, out)
    assert out.hex() == raw and avro.read_long(bytes(out), 0) == (number, len(out))


@given(st.integers(-(2**63), 2**63 - 1))
def test_numbers_round_trip(number):
    out = bytearray()
    avro.write_long(number, out)
    assert avro.read_long(bytes(out), 0) == (number, len(out))


def test_a_record_is_the_format_s_bytes():
    schema = {"type": "record", "name": "test", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]}
    assert encoded(schema, {"a": 27, "b": "foo"}).hex() == "3606666f6f"  # the example of the format's specification


def test_records_round_trip_and_resolve():
    data = encoded(WRITER, ROW)
    assert decoded(data, WRITER, WRITER) == ROW
    assert decoded(data, WRITER, READER) == {"key": -3.0, "city": "Ávila", "added": None, "tags": [{"n": 1.0}, {"n": None}], "state": "OTHER", "raw": "hi"}


def test_blocks_with_sizes():
    """A block with a negative count is followed by its size in bytes."""
    schema = {"type": "array", "items": "int"}
    assert decoded(bytes([3, 4, 2, 4, 2, 6, 0]), schema, schema) == [1, 2, 3]


@pytest.mark.parametrize(
    ("writer", "reader"),
    [("string", "int"), ("double", "float"), ("long", "int"), ({"type": "record", "name": "A", "fields": []}, {"type": "record", "name": "A", "fields": [{"name": "x", "type": "int"}]})],
)
def test_schemas_that_do_not_resolve_raise(writer, reader):
    with pytest.raises(ValueError):
        avro.decoder(avro.parsed(json.dumps(writer)), avro.parsed(json.dumps(reader)))


def test_messages_of_a_table(spark):
    rows = [(1, "a", [("x", 1), ("y", None)], {"k": True}, bytearray(b"q")), (2, None, [], {}, bytearray(b""))]
    df = spark.createDataFrame(rows, "id int, city string, tags array<struct<k:string,n:bigint>>, extra map<string,boolean>, raw binary")
    schema = json.dumps({**WRITER, "fields": [f for f in WRITER["fields"] if f["name"] in df.columns]})
    topic = avro.avro_messages(df, schema, 5, key=F.col("id"))
    assert sorted(r.key for r in topic.collect()) == ["1", "2"]
    assert sorted(avro.avro_records(topic, {5: schema}, schema).select(*df.columns).collect()) == sorted(df.collect())
    assert avro.avro_records(topic.select(F.lit(None).cast("binary").alias("value")), {5: schema}, schema).count() == 0


@pytest.mark.parametrize(("value", "said"), [("01000000050202", "wire format"), ("0000", "wire format"), ("00000000060202", "id 6"), ("0000000005", "index out of range|ends early"), ("000000000502ff", "1 bytes after")])
def test_broken_messages_raise(spark, value, said):
    schema = '{"type": "record", "name": "R", "fields": [{"name": "a", "type": "int"}]}'
    raw = spark.createDataFrame([(bytearray.fromhex(value),)], "value binary")
    with pytest.raises(Exception, match=said):
        avro.avro_records(raw, {5: schema}, schema).collect()
