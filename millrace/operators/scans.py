"""Running values over ordered rows of a key, for keys of any size.

A window puts all rows of a key into one task. Here the rows of a large key are cut into
chunks at quantiles of the order, each chunk is scanned by itself, and an associative
summary of the chunks before it (their sum, their last value) is added: the chunks'
summaries are a row each, so carrying them along is small work. Keys of up to ``LARGE`` rows
are one chunk and cost what a window costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import null_safe, small_side
from millrace.operators.selection import exact_quantile

LARGE, MOST_CHUNKS = 1_000_000, 4096


class Chunks:
    """Rows with a ``_chunk`` a key: a function of the first order column, which must be numeric or a time.

    Rows that tie in the first order column share a chunk, so a key whose rows all tie is one.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *, large: int = LARGE) -> None:
        self.keys, self.order = list(keys), list(order)
        position = self._position(df)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large)
        most = sizes.agg(F.max("_n").alias("n")).first()["n"]
        self.count = min(MOST_CHUNKS, -(-most // large)) if most else 1
        if self.count == 1:
            self.rows = df.withColumn("_chunk", F.lit(0))
            return
        hot = small_side(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys)))
        same = null_safe([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys])
        shares = [n / self.count for n in range(1, self.count)]
        cuts = df.join(hot, same, "left_semi").groupBy(*keys).agg(F.approx_percentile(position, shares, 100 * self.count).alias("_cuts"))
        cuts = small_side(cuts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.array_distinct("_cuts").alias("_cuts")))
        found = df.join(cuts, same, "left")
        chunk = F.coalesce(F.size(F.filter("_cuts", lambda c: c < position)), F.lit(0))
        self.rows = found.withColumn("_chunk", F.when(F.col("_cuts").isNull(), 0).otherwise(chunk)).drop("_cuts", *(f"_{k}" for k in keys))

    def _position(self, df: DataFrame) -> Column:
        column = F.col(self.order[0])
        kind = df.schema[self.order[0]].dataType.typeName()
        return F.unix_micros(column.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else column.cast("double")

    def window(self, *more: str):
        return Window.partitionBy(*self.keys, "_chunk", *more).orderBy(*self.order)

    def before(self, rows: DataFrame, summary: Column, carry: Column) -> DataFrame:
        """``rows`` with ``_carry``: ``carry`` over the ``_summary`` of the key's chunks before the row's."""
        if self.count == 1:
            return rows.withColumn("_carry", F.lit(None).cast(rows.groupBy(*self.keys, "_chunk").agg(summary.alias("_summary")).schema["_summary"].dataType))
        summed = rows.groupBy(*self.keys, "_chunk").agg(summary.alias("_summary"))
        earlier = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = summed.withColumn("_carry", carry.over(earlier)).filter(F.col("_chunk") > 0)
        named = small_side(carried.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.col("_chunk").alias("_of"), "_carry"))
        same = null_safe([*(F.col(k) for k in self.keys), F.col("_chunk")], [*(F.col(f"_{k}") for k in self.keys), F.col("_of")])
        return rows.join(named, same, "left").drop("_of", *(f"_{k}" for k in self.keys))

    def running_sum(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """The sum of ``value`` over the key's rows up to this one; rows that tie in the whole order count together."""
        marked = rows.withColumn("_value", value)
        carried = self.before(marked, F.sum("_value"), F.sum("_summary"))
        total = F.sum("_value").over(self.window()) + F.coalesce("_carry", F.lit(0))
        return carried.withColumn(name, total).drop("_value", "_carry")

    def lagged(self, rows: DataFrame, value: str, name: str) -> DataFrame:
        """``value`` of the key's row before this one."""
        last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*self.order))
        carried = self.before(rows, last, F.last("_summary"))
        local = self.window()
        first = F.row_number().over(local) == 1
        return carried.withColumn(name, F.when(first, F.col("_carry.v")).otherwise(F.lag(value).over(local))).drop("_carry")

    def filled(self, rows: DataFrame, column: str, resets: Column | None = None) -> DataFrame:
        """``column``'s last value that is not null so far; at a row that resets, all before it is forgotten."""
        local = self.window()
        parted = rows.withColumn("_part", F.sum(F.when(resets, 1).otherwise(0)).over(local) if resets is not None else F.lit(0))
        held = parted.withColumn("_held", F.last(column, ignorenulls=True).over(self.window("_part")))
        end = F.max_by(F.struct(F.col("_held").alias("v"), (F.col("_held").isNotNull() | (F.col("_part") > 0)).alias("known")), F.struct(*self.order))
        carry = F.last(F.when(F.col("_summary.known"), F.col("_summary")), ignorenulls=True)
        carried = self.before(held, end, carry)
        value = F.when((F.col("_part") == 0) & F.col("_held").isNull(), F.col("_carry.v")).otherwise(F.col("_held"))
        return carried.withColumn(column, value).drop("_part", "_held", "_carry")

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop("_chunk")


def indexed(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "index_100") -> DataFrame:
    """``value`` relative to the key's first in ``order``, which is 100; the first is an aggregate, joined back.

    Both sides read one exchange where ``df`` has one by the keys; Spark chooses the join by the sizes it sees.
    """
    base = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min_by(value, order).alias("_base"))
    met = df.join(base, null_safe([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys]))
    return met.withColumn(name, F.round(F.lit(100.0) * F.col(value) / F.nullif(F.col("_base"), F.lit(0.0)), 2)).drop("_base", *(f"_{k}" for k in keys))


def carried_forward(df: DataFrame, keys: Sequence[str], order: str, column: str, resets: Column | None = None, *, large: int = LARGE) -> DataFrame:
    """The last filled value so far; a reset starts anew."""
    chunks = Chunks(df, keys, [order], large=large)
    return chunks.done(chunks.filled(chunks.rows, column, resets))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, *, large: int = LARGE) -> DataFrame:
    """Session number a key: a new one after more than ``gap_seconds`` without a row."""
    timed = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    chunks = Chunks(timed, [key], ["_at"], large=large)
    waited = chunks.lagged(chunks.rows, "_at", "_before")
    new = F.when(F.col("_at") - F.col("_before") > gap_seconds * 1_000_000, 1).otherwise(0)
    return chunks.done(chunks.running_sum(waited, new, "session").drop("_at", "_before"))


def gap_segments(df: DataFrame, key: str, us: str, then: str, factor: float, *, large: int = LARGE) -> DataFrame:
    """``paragraph``: how many gaps of over ``factor`` times the key's median gap there were up to the row."""
    chunks = Chunks(df, [key], [us, then], large=large)
    gaps = chunks.lagged(chunks.rows, us, "_before").withColumn("_gap", F.col(us) - F.col("_before"))
    typical = exact_quantile(gaps, [key], "_gap", small=large if chunks.count > 1 else None).select(F.col(key).alias("_typical_of"), F.col("quantile").alias("_typical"))
    met = gaps.join(small_side(typical), F.col(key).eqNullSafe(F.col("_typical_of")))
    wide = F.when(F.col("_gap") > factor * F.col("_typical"), 1).otherwise(0)
    return chunks.done(chunks.running_sum(met, wide, "paragraph").drop("_before", "_gap", "_typical_of", "_typical"))
