"""Joins with state that ages, and late rows, over streams of several batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import flows, stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "user long, id long, kind string, ts timestamp_ntz, batch int"


def rows(n: int, seed: int, batches: int):
    r = random.Random(seed)
    out = []
    for i in range(n):
        second = r.randrange(7200)
        out.append((r.choice([1, 2, None]), i, r.choice(["view", "click", None]), START + dt.timedelta(seconds=second), min(batches - 1, (second + r.randrange(600)) * batches // 7200)))
    return out


def plain(data, ttl: int, until: dt.datetime):
    out, state = [], {}
    for user, i, kind, ts, _ in sorted((d for d in data if d[0] is not None), key=lambda d: (d[3], d[1])):
        if ts >= until:
            continue
        if kind == "view":
            state[user] = (ts, i)
        elif user in state and (ts - state[user][0]).total_seconds() < ttl:
            out.append((user, i, state[user][1], int((ts - state[user][0]).total_seconds()) * 1_000_000))
    return sorted(out)


@pytest.mark.parametrize(("batches", "ttl"), [(1, 300), (4, 120)])
def test_state_is_forgotten_by_event_time_whatever_the_batches(spark, batches, ttl):
    data = rows(150, 3, batches)
    df = spark.createDataFrame(data, SCHEMA)
    stream = flows.event_time(stateful.arriving(df, F.col("batch"), batches), "ts", "20 minutes")
    joined = stateful.state_join(stream, "user", "ts", "id", F.col("kind") == "view", ttl)
    with stateful.rocksdb_state(spark):
        done = flows.materialize(joined, "append").collect()
    want = plain(data, ttl, max(d[3] for d in data if d[0] is not None) - dt.timedelta(minutes=20))
    assert sorted(map(tuple, done)) == want and want
    assert spark.conf.get(stateful.PROVIDER, None) != stateful.ROCKSDB


@pytest.mark.parametrize(("ttl", "found"), [(3600, [(1, 2, 1)]), (0, [])])
def test_state_is_forgotten_by_processing_time(spark, ttl, found):
    """A view in the first batch, a click in the second: joined only if the store still has the view."""
    df = spark.createDataFrame([(1, 1, "view", START, 0), (1, 2, "click", START, 1), (2, 3, "click", START, 1)], SCHEMA)
    stream = flows.event_time(stateful.arriving(df, F.col("batch"), 2, files=1), "ts", "1 hour")
    joined = stateful.state_join(stream, "user", "ts", "id", F.col("kind") == "view", ttl, by_arrival=True)
    with stateful.rocksdb_state(spark, idle_batches=False):
        done = flows.materialize(joined, "append").collect()
    assert [(r.key, r.id, r.state_id) for r in done] == found


def test_late_rows_and_windows_add_up(spark):
    late = START - dt.timedelta(hours=5)
    data = [(1, i, "a", START + dt.timedelta(minutes=30 * i), 0) for i in range(6)] + [(2, 9, "b", late, 1), (2, 10, "a", late, 1), (1, 11, "a", START + dt.timedelta(hours=2, minutes=55), 1), (1, 12, None, START, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    stream = flows.event_time(stateful.arriving(df, F.col("batch"), 2, files=1), "ts", "10 minutes")
    windows, side = stateful.windows_and_late_rows(stateful.tagged_late(stream, "ts", 3600, 3), ["kind"])
    assert sorted(r.id for r in side.collect()) == [9, 10, 12]  # in batch 0 nothing is late yet
    assert sorted((r.window_start, r.kind, r.n) for r in windows.collect()) == [(START, "a", 2), (START + dt.timedelta(hours=1), "a", 2), (START + dt.timedelta(hours=2), "a", 3)]
    assert windows.agg(F.sum("n")).first()[0] + side.count() == len(data)


def test_updates_are_kept_as_batches_and_put_together(spark, tmp_path):
    folder = f"file://{tmp_path}/sink"
    schema = spark.createDataFrame([], "k int, n int").schema
    for batch, data in enumerate([[(1, 1), (None, 1)], [(1, 2), (2, 2)], [(2, 3)], [(None, 4)]]):
        flows.write_batch(spark.createDataFrame(data, schema), batch, folder)
    want = [(1, 2), (2, 3), (None, 4)]
    read = lambda: sorted(map(tuple, flows.last_version(spark, folder, schema, ["k"]).collect()), key=str)
    assert read() == want
    flows.write_batch(spark.createDataFrame([(None, 4)], schema), 3, folder)  # written again
    flows.compact(spark, folder, schema, ["k"], 2)
    assert read() == want and sorted(p.name for p in (tmp_path / "sink").iterdir()) == ["batch=2", "batch=3"]
    flows.compact(spark, folder, schema, ["k"], 2)
    assert read() == want


def test_arrival_windows_add_up_over_batches(spark):
    df = spark.createDataFrame(rows(60, 5, 3), SCHEMA)
    stream = stateful.arriving(df, F.col("batch"), 3, files=1)
    at = lambda n: F.lit("2024-06-01 00:00:00").cast("timestamp") + F.expr(f"interval {10 * n} minutes")
    done = flows.by_arrival(stream, at, "20 minutes", ["kind"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).collect()
    want = {}
    for _, _, kind, _, batch in rows(60, 5, 3):
        key = (dt.datetime(2024, 6, 1) + dt.timedelta(minutes=20 * (batch // 2)), kind)
        want[key] = want.get(key, 0) + 1
    assert {(r.window_start, r.kind): r.n for r in done} == want


@pytest.mark.parametrize(("ttl", "seen", "reads"), [(100, ["a", "a", "c"], 2), (0, ["a", "b", "c"], 4)])
def test_lookups_are_read_again_when_their_time_is_over(spark, tmp_path, ttl, seen, reads):
    """The table changes between batches; the clock says 0, 50 and 120 seconds."""
    path, times = f"file://{tmp_path}/zones", iter([0, 0, 50, 120])
    versions = iter(["a", "a", "b", "c"])

    def clock():
        spark.createDataFrame([(1, next(versions))], "k int, name string").coalesce(1).write.mode("overwrite").parquet(path)
        return next(times)

    lookup = flows.CachedLookup(lambda: spark.read.schema("k int, name string").parquet(path), ttl, clock)
    stream = stateful.arriving(spark.createDataFrame([(0, 1), (1, 1), (2, 1), (2, 9)], "id int, zone int"), F.col("id"), 3, files=1)
    done = lookup.join(stream, lambda batch: batch["zone"] == F.col("k"), ["id", "name"])
    assert [r.name for r in sorted(done.collect())] == seen and lookup.reads == reads
