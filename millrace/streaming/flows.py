"""Event-time windows, stream joins and keyed sinks on Structured Streaming.

The same functions take batch frames, where a watermark has no effect, so a
stream's complete result can be compared with the batch's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.relational import small_side
from millrace.session import shared_folder
from millrace.sources.sinks import evaluated_once


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """``ts`` as an instant, with a bounded-out-of-order watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """window_start, window_end (excluded), keys and aggregates; groups without rows do not appear."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = df.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return _bounds(grouped, "w")


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Sessions a key; window_end is the last event plus the gap."""
    return _bounds(df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates), "w")


def _bounds(df: DataFrame, w: str) -> DataFrame:
    rest = [c for c in df.columns if c != w]
    return df.select(F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end"), *rest)


def lookup_join(stream: DataFrame, dimension: DataFrame, condition: Column) -> DataFrame:
    """Inner stream-static join: rows without a match drop out; the static side is read anew each batch."""
    return stream.join(dimension, condition, "inner")


class CachedLookup:
    """A lookup table for micro-batches: a snapshot that is read again once it is older than its time to live.

    Within that time changes of the source are not seen and the source is not read; a snapshot is a folder
    of its own, so a batch that is running keeps the one it began with. ``clock`` gives seconds.
    """

    def __init__(self, read: Callable[[], DataFrame], ttl_seconds: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.read, self.ttl, self.clock = read, ttl_seconds, clock
        self.taken_at, self.snapshot, self.reads = 0.0, None, 0

    def current(self) -> DataFrame:
        now = self.clock()
        if self.snapshot is None or now - self.taken_at >= self.ttl:
            rows = self.read()
            self.snapshot = evaluated_once(rows, shared_folder(rows.sparkSession, "lookup"))
            self.taken_at, self.reads = now, self.reads + 1
        return self.snapshot

    def join(self, stream: DataFrame, condition: Callable[[DataFrame], Column], columns: Sequence[str]) -> DataFrame:
        """Inner join of each micro-batch with the snapshot of its time; the result is a table in the shared folder."""
        spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "looked-up")
        met = lambda batch: batch.join(small_side(self.current()), condition(batch), "inner").select(*columns)
        schema = met(spark.createDataFrame([], stream.schema)).schema
        write_batch(spark.createDataFrame([], schema), -1, folder)
        run_once(stream, lambda batch, n: write_batch(met(batch), n, folder), "append", shared_folder(spark, "stream"))
        return read_batches(spark, folder, schema)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, reach: str) -> DataFrame:
    """Inner join on the key within ``reach`` either way; state is dropped as the watermarks pass."""
    near = F.col(right_ts).between(F.col(left_ts) - F.expr(f"interval {reach}"), F.col(left_ts) + F.expr(f"interval {reach}"))
    return left.join(right.withColumnRenamed(key, f"_{key}"), (F.col(key) == F.col(f"_{key}")) & near).drop(f"_{key}")


def dedupe_stream(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once within the watermark's delay: what publishing again to a compacted topic amounts to."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def file_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern, so that it may be a file as well as a folder
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    """Process what is there and stop; a rerun goes on from the checkpoint."""
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    job.awaitTermination()


def write_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """A micro-batch as a folder of its id: written again, it replaces itself."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All micro-batches below ``folder``."""
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def last_version(spark: SparkSession, folder: str, schema, keys: Sequence[str]) -> DataFrame:
    """Of the micro-batches below ``folder`` the latest row of each key; null equals null."""
    versions = spark.read.schema(f"{schema_ddl(schema)}, batch long").parquet(folder)
    row = F.max_by(F.struct(*schema.names), "batch").alias("row")
    return versions.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(row).select("row.*")


def schema_ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def compact(spark: SparkSession, folder: str, schema, keys: Sequence[str], upto: int) -> None:
    """Put the batches up to ``upto``, which must not be written again, together as the latest row of each key.

    These rows are added to the batch ``upto`` before the earlier ones go, so a crash in between leaves rows
    that are there twice and are read once.
    """
    versions = spark.read.schema(f"{schema_ddl(schema)}, batch long").parquet(folder).filter(F.col("batch") <= upto)
    numbers = [r["batch"] for r in versions.select("batch").distinct().collect()]  # a number a folder
    row = F.max_by(F.struct(*schema.names), "batch").alias("row")
    versions.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(row).select("row.*").write.mode("append").parquet(f"{folder}/batch={upto}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in numbers:
        if n != upto:
            files.delete(path(f"{folder}/batch={n}"), True)
    spark.catalog.refreshByPath(folder)


def materialize(stream: DataFrame, mode: str = "complete", keys: Sequence[str] | None = None) -> DataFrame:
    """The stream's result as a table in the shared folder, a folder a micro-batch; nothing is rewritten.

    append reads all batches, update the latest row of each of ``keys``, complete the last batch, which is
    the whole result: a batch written twice replaces itself and changes nothing.
    """
    spark = stream.sparkSession
    target, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "stream")
    write_batch(spark.createDataFrame([], stream.schema), -1, target)
    run_once(stream, lambda batch, n: write_batch(batch, n, target), mode, checkpoint)
    if mode == "append":
        return read_batches(spark, target, stream.schema)
    if mode == "update":
        return last_version(spark, target, stream.schema, keys or ())
    batches = spark.read.schema(f"{schema_ddl(stream.schema)}, batch long").parquet(target)
    last = batches.agg(F.max("batch")).first()[0]
    return batches.filter(F.col("batch") == (-1 if last is None else last)).drop("batch")


def by_arrival(stream: DataFrame, at: Callable[[int], Column], size: str, keys: Sequence[str], partial: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """Windows over the time of arrival, which ``at`` gives for a micro-batch: window_start, window_end, keys and ``totals``.

    Each batch is aggregated by itself (``partial``) and the batches on reading (``totals``), so no state is
    kept, and a batch written again replaces itself with the same time.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "arrivals")
    windows = lambda batch, when: tumbling(batch.withColumn("_at", when.cast("timestamp")), "_at", size, keys, *(c.alias(name) for name, c in partial.items()))
    empty = windows(spark.createDataFrame([], stream.schema), F.lit(None))
    write_batch(empty, -1, folder)
    run_once(stream, lambda batch, n: write_batch(windows(batch, at(n)), n, folder), "append", shared_folder(spark, "stream"))
    parts = read_batches(spark, folder, empty.schema)
    return parts.groupBy("window_start", "window_end", *keys).agg(*(c.alias(name) for name, c in totals.items()))


def fan_out(batch: DataFrame, batch_id: int, sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> None:
    """Several outputs of one micro-batch that share its source: the batch is computed once."""
    batch.persist()
    try:
        for name, derive in sinks.items():
            write_batch(derive(batch), batch_id, f"{folder}/{name}")
    finally:
        batch.unpersist()
