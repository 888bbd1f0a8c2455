"""Avro records behind the registry's header: a zero byte, a 4-byte big-endian schema id, the record.

Schemas are JSON; the writer's is looked up by the id that each message carries, the reader's
is the one the table has. Records are decoded in Arrow batches by functions built once from the
two schemas: fields are matched by name or alias, missing ones take their default, numbers
are widened, unions of null and a type are nullable columns.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Read = Callable[[bytes, int], tuple[object, int]]
Write = Callable[[object, bytearray], None]

PRIMITIVES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
WIDER = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}


class Names(dict):
    """Named types of a schema, so that a name may stand for the type."""

    def parsed(self, schema) -> dict | list | str:
        if isinstance(schema, list):
            return [self.parsed(s) for s in schema]
        if isinstance(schema, str):
            return schema if schema in PRIMITIVES or schema == "null" else self[schema.rpartition(".")[2]]
        kind = schema["type"]
        if kind in ("record", "enum", "fixed"):
            self[schema["name"].rpartition(".")[2]] = schema
            return {**schema, "fields": [{**f, "type": self.parsed(f["type"])} for f in schema["fields"]]} if kind == "record" else schema
        if kind in ("array", "map"):
            part = "items" if kind == "array" else "values"
            return {**schema, part: self.parsed(schema[part])}
        return self.parsed(kind)


def parsed(schema: str) -> dict | list | str:
    return Names().parsed(json.loads(schema))


def kind_of(schema) -> str:
    return "union" if isinstance(schema, list) else schema if isinstance(schema, str) else schema["type"]


def nullable(schema) -> tuple[object, int] | None:
    """Of a union of null and one type: the type, and which branch is null."""
    if isinstance(schema, list) and len(schema) == 2 and "null" in schema:
        at = schema.index("null")
        return schema[1 - at], at
    return None


def spark_type(schema) -> T.DataType:
    kind = kind_of(schema)
    if kind == "union":
        if nullable(schema) is None:
            raise ValueError("only unions of null and one type have a column type")
        return spark_type(nullable(schema)[0])
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    return PRIMITIVES[{"enum": "string", "fixed": "bytes"}.get(kind, kind)]


def read_long(data: bytes, at: int) -> tuple[int, int]:
    """A zig-zag number of seven bits a byte, the lowest first."""
    shift = number = 0
    while True:
        byte = data[at]
        at += 1
        number |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (number >> 1) ^ -(number & 1), at
        shift += 7


def write_long(number: int, out: bytearray) -> None:
    number = (number << 1) ^ (number >> 63)
    while number > 0x7F:
        out.append(number & 0x7F | 0x80)
        number >>= 7
    out.append(number)


def read_bytes(data: bytes, at: int, size: int | None = None) -> tuple[bytes, int]:
    if size is None:
        size, at = read_long(data, at)
    if size < 0 or at + size > len(data):
        raise IndexError("the record ends early")
    return data[at : at + size], at + size


def _read_number(data: bytes, at: int, code: str) -> tuple[float, int]:
    raw, at = read_bytes(data, at, struct.calcsize(code))
    return struct.unpack(code, raw)[0], at


def _read_items(data: bytes, at: int, one: Read) -> tuple[list, int]:
    """The items of an array's or map's blocks; a negative count is followed by the block's size."""
    items: list = []
    while True:
        count, at = read_long(data, at)
        if not count:
            return items, at
        if count < 0:
            count, (_, at) = -count, read_long(data, at)
        for _ in range(count):
            item, at = one(data, at)
            items.append(item)


def _read_record(data: bytes, at: int, fields: list[tuple[str | None, Read]], defaults: dict) -> tuple[dict, int]:
    row = dict(defaults)
    for name, read in fields:
        value, at = read(data, at)
        if name is not None:
            row[name] = value
    return row, at


def _converted(read: Read, change: Callable) -> Read:
    def converted(data: bytes, at: int) -> tuple[object, int]:
        value, at = read(data, at)
        return change(value), at

    return converted


def _pair(data: bytes, at: int, value: Read) -> tuple[tuple[str, object], int]:
    key, at = read_bytes(data, at)
    found, at = value(data, at)
    return (key.decode(), found), at


def _branch(data: bytes, at: int, branches: list[Read | None]) -> tuple[object, int]:
    which, at = read_long(data, at)
    read = branches[which] if 0 <= which < len(branches) else None
    if read is None:
        raise ValueError(f"branch {which} of a union has no place in the reader's schema")
    return read(data, at)


def fits(writer, reader) -> bool:
    """Whether a value of the one schema can be read by the other."""
    w, r = kind_of(writer), kind_of(reader)
    if r == "union":
        return any(fits(writer, x) for x in reader)
    if w == "union":
        return any(fits(x, reader) for x in writer)
    if w in ("record", "enum", "fixed") and w == r:
        return writer["name"].rpartition(".")[2] in [n.rpartition(".")[2] for n in (reader["name"], *reader.get("aliases", ()))]
    if w == r and w in ("array", "map"):
        part = "items" if w == "array" else "values"
        return fits(writer[part], reader[part])
    return w == r or r in WIDER.get(w, ())


def decoder(writer, reader) -> Read:
    """A function that reads what ``writer`` wrote as a value of ``reader``."""
    if not fits(writer, reader):
        raise ValueError(f"a {kind_of(writer)} cannot be read as a {kind_of(reader)}")
    w = kind_of(writer)
    if w == "union":
        return partial(_branch, branches=[decoder(x, reader) if fits(x, reader) else None for x in writer])
    if kind_of(reader) == "union":
        return decoder(writer, next((x for x in reader if kind_of(x) == w and fits(writer, x)), None) or next(x for x in reader if fits(writer, x)))
    if w == "record":
        wanted = {n: f for f in reader["fields"] for n in (f["name"], *f.get("aliases", ()))}
        fields = [(wanted[f["name"]]["name"], decoder(f["type"], wanted[f["name"]]["type"])) if f["name"] in wanted else (None, decoder(f["type"], f["type"])) for f in writer["fields"]]
        missing = [f for f in reader["fields"] if f["name"] not in [n for n, _ in fields]]
        if lacking := [f["name"] for f in missing if "default" not in f]:
            raise ValueError(f"fields without a value or default: {', '.join(lacking)}")
        return partial(_read_record, fields=fields, defaults={f["name"]: f["default"] for f in missing})
    if w == "array":
        return partial(_read_items, one=decoder(writer["items"], reader["items"]))
    if w == "map":
        return _converted(partial(_read_items, one=partial(_pair, value=decoder(writer["values"], reader["values"]))), dict)
    if w == "enum":
        known = set(reader["symbols"])
        named = [s if s in known else reader.get("default") for s in writer["symbols"]]
        return _converted(read_long, lambda n: named[n])
    if w == "fixed":
        return partial(read_bytes, size=writer["size"])
    plain: dict[str, Read] = {
        "null": lambda data, at: (None, at),
        "boolean": lambda data, at: (read_bytes(data, at, 1)[0] != b"\0", at + 1),
        "int": read_long,
        "long": read_long,
        "float": partial(_read_number, code="<f"),
        "double": partial(_read_number, code="<d"),
        "bytes": read_bytes,
        "string": read_bytes,
    }
    r = kind_of(reader)
    if r == "string":
        return _converted(plain[w], lambda b: b.decode())
    return _converted(plain[w], float) if r in ("float", "double") and w in ("int", "long") else plain[w]


def encoder(schema) -> Write:
    """A function that appends a value of ``schema`` to a buffer."""
    kind = kind_of(schema)
    if kind == "union":
        inner, null = nullable(schema) or (None, None)
        if inner is None:
            raise ValueError("only unions of null and one type can be written")
        write = encoder(inner)
        return lambda v, out: write_long(null, out) if v is None else (write_long(1 - null, out), write(v, out))[1]
    if kind == "record":
        fields = [(f["name"], encoder(f["type"])) for f in schema["fields"]]

        def record(v: dict, out: bytearray) -> None:
            for name, write in fields:
                write(v[name], out)

        return record
    if kind in ("array", "map"):
        write, key = encoder(schema["items" if kind == "array" else "values"]), encoder("string")

        def block(v, out: bytearray) -> None:
            items = list(v.items() if isinstance(v, dict) else v)
            if items:
                write_long(len(items), out)
            for item in items:
                if kind == "map":
                    key(item[0], out)
                    item = item[1]
                write(item, out)
            out.append(0)

        return block
    if kind == "enum":
        return lambda v, out: write_long(schema["symbols"].index(v), out)
    if kind == "fixed":
        return lambda v, out: out.extend(v)
    if kind in ("bytes", "string"):

        def sized(v, out: bytearray) -> None:
            raw = v.encode() if isinstance(v, str) else v
            write_long(len(raw), out)
            out.extend(raw)

        return sized
    plain: dict[str, Write] = {
        "null": lambda v, out: None,
        "boolean": lambda v, out: out.append(1 if v else 0),
        "int": write_long,
        "long": write_long,
        "float": lambda v, out: out.extend(struct.pack("<f", v)),
        "double": lambda v, out: out.extend(struct.pack("<d", v)),
    }
    return plain[kind]


def avro_messages(df: DataFrame, schema: str, schema_id: int, *, key: Column | None = None) -> DataFrame:
    """key and value: each row as a record of ``schema`` behind the header; columns go by the fields' names.

    Null in a field that is not a union of null raises.
    """
    fields = [f["name"] for f in parsed(schema)["fields"]]
    head = b"\0" + struct.pack(">I", schema_id)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = encoder(parsed(schema))
        for batch in batches:
            values = []
            for row in batch.column("row").to_pylist(maps_as_pydicts="strict"):
                out = bytearray(head)
                write(row, out)
                values.append(bytes(out))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.binary())], names=["key", "value"])

    rows = df.select((key if key is not None else F.lit(None)).cast("string").alias("key"), F.struct(*fields).alias("row"))
    return rows.mapInArrow(encoded, "key string, value binary")


def avro_records(raw: DataFrame, schemas: dict[int, str], reader: str, *, value: str = "value") -> DataFrame:
    """The records of messages ``value`` as columns of the ``reader`` schema, whichever of ``schemas`` wrote them.

    Another first byte than zero, an id that is not among ``schemas``, a record that ends early or goes on
    after its last field raise. A null message is left out.
    """
    target = parsed(reader)
    kind = spark_type(target)
    arrow = to_arrow_schema(kind)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Read] = {}
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                if data[:1] != b"\0" or len(data) < 5:
                    raise ValueError(f"not in the registry's wire format: first byte {data[:1]!r}")
                number = int.from_bytes(data[1:5], "big")
                if number not in known:
                    if number not in schemas:
                        raise ValueError(f"no schema has the id {number}")
                    known[number] = decoder(parsed(schemas[number]), target)
                row, end = known[number](data, 5)
                if end != len(data):
                    raise ValueError(f"{len(data) - end} bytes after the record")
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return raw.select(F.col(value).alias("value")).filter("value is not null").mapInArrow(decoded, kind)
