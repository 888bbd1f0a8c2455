"""Streams with state of their own: a join with state that ages, late rows to a side output."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import shared_folder
from millrace.streaming import flows

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def rocksdb_state(spark: SparkSession, *, idle_batches: bool = True) -> Iterator[None]:
    """State kept on the executors' disks and checkpointed, which state with several variables needs.

    ``idle_batches``: a batch without rows follows where time has passed; state by processing time would
    ask for one after another, so that a run over what is there never ended.
    """
    wanted = {PROVIDER: ROCKSDB, IDLE_BATCHES: str(idle_batches).lower()}
    former = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in former.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arriving(df: DataFrame, arrival: Column, slices: int, files: int = 2) -> DataFrame:
    """A stream of ``df`` whose micro-batches are the slices 0, 1, ... of ``arrival``, each of so many files.

    Slices are written one after the other, so that their files are read in that order; rows whose
    arrival is null or beyond come with the last slice.
    """
    folder = shared_folder(df.sparkSession, "arrivals")
    numbered = df.withColumn("_slice", F.least(F.coalesce(arrival.cast("int"), F.lit(slices - 1)), F.lit(slices - 1)))
    for n in range(slices):
        numbered.filter(F.col("_slice") == n).drop("_slice").repartition(files).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


JOINED = "key long, id long, state_id long, age_us long"


def _joined(key, found: list[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
    if found:
        ids, states, ages = zip(*found, strict=True)
        yield pd.DataFrame({"key": [key[0]] * len(ids), "id": ids, "state_id": states, "age_us": ages})


class LatestByEventTime(StatefulProcessor):
    """Rows wait for the watermark and are then taken in the order of their time, however they arrived.

    A row that sets state replaces the key's; any other is joined with it if it is younger than the
    time to live. State that the watermark has outlived is removed by a timer, so a key that falls
    silent leaves nothing behind.
    """

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, sets boolean")
        self.latest = handle.getValueState("latest", "us long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                self.waiting.appendList(list(zip(part["us"].tolist(), part["id"].tolist(), part["sets"].tolist(), strict=True)))
                first = min(part["us"].min(), first) if first is not None else part["us"].min()
        if first is not None:
            self.handle.registerTimer(int(first) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] // 1000 < now]
        state, found = self.latest.get() if self.latest.exists() else None, []
        for us, row, sets in due:
            if sets:
                state = (us, row)
            elif state and us - state[0] < self.ttl_us:
                found.append((row, state[1], us - state[0]))
        if due:
            rest = rows[len(due) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self.handle.registerTimer(rest[0][0] // 1000)
        if state and (state[0] + self.ttl_us) // 1000 >= now:
            self.latest.update(state)
            self.handle.registerTimer((state[0] + self.ttl_us) // 1000)
        elif self.latest.exists():
            self.latest.clear()
        yield from _joined(key, found)

    def close(self) -> None:
        pass


class LatestByArrival(StatefulProcessor):
    """Rows are taken batch by batch; the state's age is the time since it arrived, and the store forgets it."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "us long, id long", ttlDurationMs=max(1, self.ttl_us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken = sorted(r for part in rows for r in zip(part["us"].tolist(), part["id"].tolist(), part["sets"].tolist(), strict=True))
        state, new, found = self.latest.get() if self.latest.exists() else None, False, []
        for us, row, sets in taken:
            if sets:
                state, new = (us, row), True
            elif state:
                found.append((row, state[1], us - state[0]))
        if new:
            self.latest.update(state)
        yield from _joined(key, found)

    def close(self) -> None:
        pass


def state_join(stream: DataFrame, key: str, ts: str, row_id: str, sets: Column, ttl_seconds: int, *, by_arrival: bool = False) -> DataFrame:
    """key, id, state_id and age_us: each row that sets no state beside the key's last that does, if it is young enough.

    By event time (``ts`` needs a watermark) the result does not depend on the order of arrival within
    the watermark's delay; rows of equal time are taken by id; rows that the watermark has not reached
    are withheld. By arrival the state lives for ``ttl_seconds`` of processing time. Null keys are
    dropped. Run it within ``rocksdb_state``, by
    arrival without idle batches.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    given = stream.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(row_id).cast("long").alias("id"), us.alias("us"), F.coalesce(sets, F.lit(False)).alias("sets"), F.col(ts))
    processor, mode = (LatestByArrival, "ProcessingTime") if by_arrival else (LatestByEventTime, "EventTime")
    return given.groupBy("key").transformWithStateInPandas(processor(ttl_seconds * 1_000_000), JOINED, "append", mode)


def tagged_late(stream: DataFrame, ts: str, size_seconds: int, lanes: int) -> DataFrame:
    """The stream's rows with the window they belong to, and whether it was closed when they arrived.

    A row is late if the watermark has passed its window's end; with the watermark itself Spark would
    drop it unseen. Rows are dealt to ``lanes`` by a hash of the row, each of which counts what it saw.
    """
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    start = seconds - F.pmod(seconds, F.lit(size_seconds))
    keyed = stream.withColumns({"window_start": F.timestamp_seconds(start), "window_end": F.timestamp_seconds(start + size_seconds), "late": F.lit(False), "lane": F.pmod(F.xxhash64(*stream.columns), F.lit(lanes))})

    def tag(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        seen, late = state.get if state.exists else (0, 0)
        for part in parts:
            part["late"] = part["window_end"] <= passed
            seen, late = seen + len(part), late + int(part["late"].sum())
            yield part
        state.update((seen, late))

    return keyed.groupBy("lane").applyInPandasWithState(tag, keyed.schema, "seen long, late long", "append", GroupStateTimeout.NoTimeout)


def windows_and_late_rows(tagged: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two outputs of one micro-batch: rows a window and key that came in time, and the late rows as they are.

    Counts are written a batch and added up on reading, so a batch written again changes nothing.
    """
    spark, folder = tagged.sparkSession, shared_folder(tagged.sparkSession, "late")
    by_window = ["window_start", "window_end", *keys]
    counted = lambda b: b.filter("not late").groupBy(*by_window).agg(F.count(F.lit(1)).alias("n"))
    late = lambda b: b.filter("late").drop("lane", "late")
    sinks = {"windows": counted, "late": late}
    flows.run_once(tagged, lambda batch, n: flows.fan_out(batch, n, sinks, folder), "append", shared_folder(spark, "stream"))
    empty = spark.createDataFrame([], tagged.schema)
    read = {name: flows.read_batches(spark, f"{folder}/{name}", derive(empty).schema) for name, derive in sinks.items()}
    return read["windows"].groupBy(*by_window).agg(F.sum("n").alias("n")), read["late"]
