"""Message topics: reader options for every start and end mode, and wire formats."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.schema import lenient_json


def start_options(mode: str, *, timestamp_ms: int | None = None, offsets: dict | None = None) -> dict[str, str]:
    """Kafka reader options: earliest, latest, timestamp, offsets; group resumes from the checkpoint."""
    if mode in ("earliest", "latest"):
        return {"startingOffsets": mode}
    if mode == "timestamp" and timestamp_ms is not None:
        return {"startingTimestamp": str(timestamp_ms), "startingOffsetsByTimestampStrategy": "latest"}
    if mode == "offsets" and offsets:
        return {"startingOffsets": json.dumps(offsets)}
    if mode == "group":
        return {}
    raise ValueError(f"unknown or incomplete start mode: {mode}")


def end_options(mode: str | None, *, timestamp_ms: int | None = None) -> dict[str, str]:
    """Options that bound a batch read; None leaves it unbounded."""
    if mode is None:
        return {}
    if mode == "latest":
        return {"endingOffsets": "latest"}
    if mode == "timestamp" and timestamp_ms is not None:
        return {"endingTimestamp": str(timestamp_ms)}
    raise ValueError(f"unknown or incomplete end mode: {mode}")


def read_topic(spark: SparkSession, servers: str, topic: str, start: dict[str, str], end: dict[str, str] | None = None) -> DataFrame:
    """The raw records, as a stream or, with ``end``, as a bounded batch. Needs the Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, **start, **(end or {})}
    return (spark.read if end else spark.readStream).format("kafka").options(**options).load()


def json_records(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Records whose value is JSON of ``schema``; others are ignored."""
    return lenient_json(raw.select(F.col("value").cast("string").alias("value")), "value", schema)


def as_messages(df: DataFrame, key: Column) -> DataFrame:
    """key and value (JSON) as a topic takes them."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def registry_header(value: Column) -> Column:
    """magic, schema_id and payload of the registry's wire format (a zero byte, a 4-byte big-endian id, the record)."""
    number = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int")
    payload = F.substring(value, F.lit(6), F.octet_length(value))
    return F.struct(F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int").alias("magic"), number.alias("schema_id"), payload.alias("payload"))
