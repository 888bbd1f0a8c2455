"""Data-quality checks: each returns the offending rows, so an empty result passes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once, with their count; null keys are not compared."""
    filled = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.filter(filled).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def accepted_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.filter(~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Filled foreign keys without a parent."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_parent")), F.col(column) == F.col("_parent"), "left_anti")


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) <= 0)


def non_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


def expression_is_true(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def not_null_share(df: DataFrame, column: str, at_least: float) -> DataFrame:
    """One row with the share if it is too small."""
    return df.agg((F.count(column) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share")).filter(F.col("share") < at_least)


def column_count_between(df: DataFrame, least: int, most: int) -> bool:
    return least <= len(df.columns) <= most


def freshness(df: DataFrame, loaded_at: str, now: Column, warn_hours: float, error_hours: float) -> DataFrame:
    """age_hours and status (pass, warn or error) of the newest row."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max(loaded_at).cast("timestamp"))) / 3600
    newest = df.agg(age.alias("age_hours"))
    return newest.withColumn("status", F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


def contract_violations(df: DataFrame, contract: T.StructType) -> list[str]:
    """Missing, unexpected and mistyped columns."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in contract}
    out = [f"missing column {c}" for c in want if c not in have] + [f"unexpected column {c}" for c in have if c not in want]
    return out + [f"column {c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]


def audit(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-level comparison of two versions: keys with only_a, only_b or changed."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_in_b"))
    both = left.join(right, list(keys), "outer")
    status = F.when(F.col("_in_b").isNull(), "only_a").when(F.col("_in_a").isNull(), "only_b").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*keys, status.alias("status")).filter(F.col("status").isNotNull())


def row_failures(df: DataFrame, offends: dict[str, Column]) -> DataFrame:
    """check and failures of conditions on single rows of one table: one scan for all of them."""
    counted = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"n{i}") for i, c in enumerate(offends.values())))
    named = [F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("failures")) for i, name in enumerate(offends)]
    return counted.select(F.inline(F.array(*named)))


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """check and failures, a row for each named check; a scan each, for checks that need more than a row."""
    counts = [df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures") for name, df in checks.items()]
    return reduce(DataFrame.union, counts)
