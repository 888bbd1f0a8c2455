"""Exact quantiles of large groups by selection: counts of radix buckets instead of sorted values.

A value becomes a 64-bit key whose order is the value's. A pass counts the keys of each group
by their next ``DIGIT`` bits, finds the bucket that holds the wanted rank and goes on inside
it; after 64 / DIGIT passes the bucket is one value. What is shuffled is a count a bucket and
task, at most 2 ** DIGIT a group, whatever the group's size. Groups of up to ``SMALL`` rows
are aggregated as they are: their buffers are bounded by that.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from millrace.operators.relational import null_safe, small_side
from millrace.session import shared_folder
from millrace.sources.sinks import evaluated_once

DIGIT, SMALL = 16, 1_000_000
_MAGNITUDE = np.int64(2**63 - 1)


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Between a double's bits and a long of the same order: negative numbers count down."""
    return np.where(bits < 0, bits ^ _MAGNITUDE, bits)


@F.pandas_udf(LongType())
def sortable(value: pd.Series) -> pd.Series:
    """A long whose order is that of the doubles; both zeros are one, NaN is the largest."""
    numbers = value.to_numpy(dtype=float, na_value=np.nan) + 0.0
    return pd.Series(_flipped(np.where(np.isnan(numbers), np.nan, numbers).view(np.int64))).where(value.notna() | np.isnan(numbers))


@F.pandas_udf(DoubleType())
def unsortable(key: pd.Series) -> pd.Series:
    return pd.Series(_flipped(key.to_numpy(dtype=np.int64)).view(float))


def _narrowed(rows: DataFrame, targets: DataFrame, keys: Sequence[str], shift: int, first: bool) -> DataFrame:
    """``targets`` (keys, which, rank, prefix) one digit further: the bucket that holds the rank, and the rank in it."""
    named = targets.select(*(F.col(k).alias(f"_{k}") for k in keys), "which", "rank", "prefix")
    met = rows.join(small_side(named), null_safe([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys]))
    if not first:
        met = met.filter(F.shiftright("_sortable", shift + DIGIT) == F.col("prefix"))
    bucket = F.shiftright("_sortable", shift).alias("bucket")
    counted = met.groupBy(*keys, "which", "rank", bucket).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "which").orderBy("bucket"))
    return counted.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select(*keys, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("bucket").alias("prefix"))


def selected(df: DataFrame, keys: Sequence[str], value: str, q: float, groups: DataFrame) -> DataFrame:
    """keys and ``quantile``: the continuous ``q``-quantile of each of ``groups`` (keys and n), by selection."""
    folder = shared_folder(df.sparkSession, "selection")
    place = F.lit(q) * (F.col("n") - 1)
    ranks = F.array(F.struct(F.lit(0).alias("which"), F.floor(place).cast("long").alias("rank")), F.struct(F.lit(1).alias("which"), F.ceil(place).cast("long").alias("rank")))
    targets = groups.select(*keys, F.inline(ranks)).withColumn("prefix", F.lit(0).cast("long"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, sortable(F.col(value).cast("double")).alias("_sortable"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        targets = evaluated_once(_narrowed(rows, targets, keys, shift, shift == 64 - DIGIT), f"{folder}/{shift}")  # two rows a group
    named = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), place.alias("place"))
    found = targets.withColumn("v", unsortable("prefix")).groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("which") == 1, F.col("v"))).alias("hi"))
    part = F.col("place") - F.floor("place")
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (1 - part) + F.col("hi") * part)
    return found.join(small_side(named), null_safe([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys])).select(*keys, between.alias("quantile"))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, *, small: int | None = SMALL, **aggregates: Column) -> DataFrame:
    """keys, ``quantile`` (continuous, exact) of ``value``, and further aggregates a group.

    Null values do not count, a group without others has a null quantile; null keys are a group; NaN is
    the largest value. ``small`` is the size up to which a group is aggregated as it is; None if all are known
    to be small.
    """
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    large = sizes.filter(F.col("n") > (small or 0))
    others = [a.alias(name) for name, a in aggregates.items()]
    whole = F.percentile(F.col(value).cast("double"), q).alias("quantile")
    if small is None or not large.limit(1).count():
        return df.groupBy(*keys).agg(whole, *others)
    groups = evaluated_once(large, shared_folder(df.sparkSession, "groups"))
    by_selection = selected(df, keys, value, q, groups)
    marked = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_large"))
    same = null_safe([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys])
    rest = df.join(small_side(marked), same, "left").withColumn("_value", F.when(F.col("_large").isNull(), F.col(value).cast("double")))
    summed = rest.groupBy(*keys).agg(F.percentile("_value", q).alias("_quantile"), *others)
    chosen = by_selection.select(*(F.col(k).alias(f"_{k}") for k in keys), "quantile")
    return summed.join(small_side(chosen), same, "left").select(*keys, F.coalesce("quantile", "_quantile").alias("quantile"), *aggregates)
