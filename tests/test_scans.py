"""Quantiles by selection and running values in chunks against plain versions, on one hot key."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.operators import scans, selection


def quantile(values, q):
    place = q * (len(values) - 1)
    lo, hi = values[math.floor(place)], values[math.ceil(place)]
    return lo if lo == hi else lo * (1 - place % 1) + hi * (place % 1)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantile_of_one_hot_group(spark, q):
    r = random.Random(4)
    rows = [("hot", r.choice([r.gauss(0, 1e-3), r.gauss(5, 1e9), -0.0, 0.0, 7.5, r.uniform(1, 1.0001), -1e300, 5e-324])) for _ in range(1501)]
    rows += [("hot", None), (None, 2.0), (None, 4.0), ("none", None), *(("cold", float(i)) for i in range(10))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    done = {x.k: (x["quantile"], x.n) for x in selection.exact_quantile(df, ["k"], "v", q, small=50, n=F.count(F.lit(1))).collect()}
    want = {k: sorted(v for g, v in rows if g == k and v is not None) for k in ("hot", "cold", None)}
    assert {k: v[0] for k, v in done.items()} == {**{k: pytest.approx(quantile(v, q), rel=1e-12) for k, v in want.items()}, "none": None}
    assert done["hot"][1] == 1502


def test_selection_counts_buckets_and_keeps_no_group(spark, monkeypatch):
    """The largest group of rows that any pass brings together is a group's buckets, not its rows."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 37 % 199_999).cast("double").alias("v"))
    counted, made = [], selection._narrowed

    def narrowed(rows, targets, keys, shift, first):
        met = rows if first else rows.filter(F.shiftright("_sortable", shift + selection.DIGIT).isin([x.prefix for x in targets.collect()]))
        counted.append(met.select(F.shiftright("_sortable", shift)).distinct().count())
        return made(rows, targets, keys, shift, first)

    monkeypatch.setattr(selection, "_narrowed", narrowed)
    done = selection.exact_quantile(df, ["k"], "v", small=1000).collect()
    values = sorted(i * 37 % 199_999 for i in range(200_000))
    assert [x["quantile"] for x in done] == [(values[99_999] + values[100_000]) / 2]
    assert len(counted) == 4 and max(counted) <= 2**selection.DIGIT and sum(counted) < 200_000


def test_sortable_keys_keep_the_order():
    values = [-math.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf]
    keys = selection._flipped(np.array(values).view(np.int64))
    assert keys.tolist() == sorted(keys.tolist()) and selection._flipped(keys).view(float).tolist() == values


# --- chunks ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hot(spark):
    r = random.Random(9)
    rows = [(1, i, r.choice([None, None, f"h{i}"]), r.random() < 0.02, 1_700_000_000 + i * 60 + r.randrange(600)) for i in range(1000)]
    rows += [(k, i, None if i % 3 else f"x{i}", i % 4 == 0, 1_700_000_000 + i * 1000) for k in (2, None) for i in range(7)]
    return rows, spark.createDataFrame(rows, "k int, i int, heading string, reset boolean, at long").repartition(6)


def test_hot_keys_are_cut_into_even_chunks(hot):
    chunks = scans.Chunks(hot[1], ["k"], ["i"], large=50)
    sizes = [r["count"] for r in chunks.rows.groupBy("k", "_chunk").count().filter("k = 1").collect()]
    assert chunks.count == 20 and len(sizes) == 20 and max(sizes) < 2 * 1000 / 20  # the largest task has under 2 / n of the rows
    assert scans.Chunks(hot[1], ["k"], ["i"]).count == 1


@pytest.mark.parametrize("large", [50, 10_000])
@pytest.mark.parametrize("with_resets", [True, False])
def test_carry_forward_over_chunks(hot, large, with_resets):
    rows, df = hot
    want, held = {}, {}
    for k, i, heading, reset, _ in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        held[k] = heading if heading is not None else None if with_resets and reset else held.get(k)
        want[k, i] = held[k]
    done = scans.carried_forward(df, ["k"], "i", "heading", F.col("reset") if with_resets else None, large=large)
    assert done.columns == df.columns
    assert {(r.k, r.i): r.heading for r in done.collect()} == want


@pytest.mark.parametrize("large", [50, 10_000])
def test_sessions_over_chunks(hot, large):
    rows, df = hot
    want, last, n = {}, {}, {}
    for k, i, _, _, at in sorted(rows, key=lambda x: (str(x[0]), x[4])):
        n[k] = n.get(k, 0) + (k in last and at - last[k] > 300)
        want[k, i], last[k] = n[k], at
    timed = df.withColumn("ts", F.timestamp_seconds("at"))
    assert {(r.k, r.i): r.session for r in scans.sessions(timed, "k", "ts", 300, large=large).collect()} == want


@pytest.mark.parametrize("large", [50, 10_000])
def test_gap_segments_over_chunks(hot, large):
    rows, df = hot
    want = {}
    for key in (1, 2, None):
        own = sorted((at, i) for k, i, _, _, at in rows if k == key)
        gaps = [b[0] - a[0] for a, b in zip(own, own[1:])]
        limit, n = 1.6 * quantile(sorted(gaps), 0.5), 0
        for j, (_, i) in enumerate(own):
            n += j > 0 and gaps[j - 1] > limit
            want[key, i] = n
    assert {(r.k, r.i): r.paragraph for r in scans.gap_segments(df.select("k", "i", "at"), "k", "at", "i", 1.6, large=large).collect()} == want


def test_not_in_keeps_sql_semantics_without_a_broadcast(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some, none, null = (spark.createDataFrame(x, "b int") for x in ([(2,), (2,)], [], [(2,), (None,)]))
    got = [sorted((r.a for r in R.not_in(left, "a", x).collect()), key=str) for x in (some, none, null)]
    assert got == [[1], [1, 2, None], []]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in R.not_in(left, "a", some)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_delete_insert_by_several_keys_that_may_be_null(spark):
    old = spark.createDataFrame([(1, 1, "old"), (1, 2, "old"), (None, 1, "old")], "a int, b int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (None, 1, "new"), (None, 1, "new too")], old.schema)
    once = R.delete_insert(old, new, ["a", "b"])
    assert sorted(map(tuple, R.delete_insert(once, new, ["a", "b"]).collect()), key=str) == sorted([(1, 1, "new"), (1, 2, "old"), (None, 1, "new"), (None, 1, "new too")], key=str)
