"""Distinct counts as sketches that are kept and united: a year from its days, without their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_BITS = 12  # 4,096 registers, about two kilobytes a sketch whatever it counts
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)  # standard error of an estimate, relative


def distinct_sketches(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys and ``sketch`` of the different values of ``column``; null values do not count."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, SKETCH_BITS).alias("sketch"))


def united_sketches(sketches: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """keys, ``sketch`` of all rows together, its ``estimate``, and further aggregates."""
    others = [a.alias(name) for name, a in aggregates.items()]
    united = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), *others)
    return united.withColumn("estimate", F.hll_sketch_estimate("sketch"))
