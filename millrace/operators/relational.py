"""DataFrame to DataFrame operators: dedupe, best match, top-k, paging, merges, completion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many rows; beyond, Spark chooses.
BROADCAST_ROWS = 100_000


def null_safe(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equal column by column, where null equals null."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)), F.lit(True))


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small enough."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in ``order`` (give a total order for a repeatable result)."""
    return numbered(df, keys, order, "_nth").filter("_nth = 1").drop("_nth")


def union_all(frames: Sequence[DataFrame], *, by_name: bool = False, tolerant: bool = False) -> DataFrame:
    """UNION ALL by position, by name, or by name with missing columns as null."""
    if tolerant:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return reduce(DataFrame.unionByName if by_name else DataFrame.union, frames)


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both frames, in the order of the first."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ends(df: DataFrame, n: int, order: Sequence[Column], reverse: Sequence[Column], names: tuple[str, str] = ("recent", "oldest")) -> DataFrame:
    """The first n in either direction, tagged."""
    return top(df, n, *order).withColumn("group", F.lit(names[0])).unionByName(top(df, n, *reverse).withColumn("group", F.lit(names[1])))


def row_before(columns: Sequence[str], values: Sequence[Column]) -> Column:
    """(a, b, c) < (x, y, z) with SQL's null rule: a null among the columns never compares true."""
    filled = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return filled & (F.struct(*columns) < F.struct(*(v.alias(c) for c, v in zip(columns, values, strict=True))))


def keyset_page(df: DataFrame, keys: Sequence[str], size: int, after: Sequence | None = None) -> DataFrame:
    """The next ``size`` + 1 rows in descending key order; the extra row tells whether there are more."""
    if after is not None:
        df = df.filter(row_before(keys, [F.lit(v) for v in after]))
    return df.orderBy(*(F.desc(k) for k in keys)).limit(size + 1)


def pivot_codes(df: DataFrame, keys: Sequence[str], code: str, value: str, names: dict) -> DataFrame:
    """Long to wide for a fixed list of codes; others drop out."""
    wide = df.groupBy(*keys).pivot(code, list(names)).agg(F.max(value))
    return wide.select(*keys, *(F.col(f"`{c}`").alias(n) for c, n in names.items()))


def best_matches(df: DataFrame, dictionary: DataFrame, on: str, keys: Sequence[str], priority: str, then: str) -> DataFrame:
    """Left join; of several dictionary rows the best priority (nulls last) wins."""
    return keep_first(df.join(dictionary, on, "left"), keys, [F.asc_nulls_last(priority), F.asc(then)])


def either_key_join(left: DataFrame, right: DataFrame, key: str, candidates: Sequence[str], how: str = "left") -> DataFrame:
    """left.key equal to any of right's candidate columns, as an equi join: each right row is offered once a distinct candidate."""
    offered = right.withColumn("_candidate", F.explode(F.array_distinct(F.array(*candidates))))
    return left.join(offered, left[key] == offered["_candidate"], how).drop("_candidate")


# --- merges without a transactional table -------------------------------------------


def without_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``; null equals null."""
    named = other.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    return df.join(named, null_safe([F.col(k) for k in keys], [F.col(f"_key{i}") for i in range(len(keys))]), "left_anti")


def last_written(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row a key: the greatest by ``order``, then by the other columns, so that it does not depend on arrival."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return keep_first(df, keys, [F.desc_nulls_last(c) for c in (*order, *rest)] or [F.lit(0)])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of equal key; of several with one key the last by ``order`` counts."""
    return without_keys(old, new, keys).unionByName(last_written(new, keys, order))


def insert_only(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows of ``new`` whose key is not there yet, each once."""
    return old.unionByName(without_keys(last_written(new, keys), old, keys))


def replace_interval(old: DataFrame, new: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Delete [start, end) by ``column``, then insert what ``new`` has there."""
    inside = (F.col(column) >= start) & (F.col(column) < end)
    return old.filter(~F.coalesce(inside, F.lit(False))).unionByName(new.filter(inside))


def delete_insert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete every old row whose keys occur in ``new``, then insert ``new``; null equals null."""
    return without_keys(old, new, keys).unionByName(new)


def not_in(df: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Rows whose ``column`` is NOT IN the one column of ``listed``, as SQL has it, by a shuffled anti join.

    A null in the list leaves nothing; a null in ``column`` stays only if the list is empty. Both are
    told by one row of counts, where NOT IN itself would send the whole list to every executor.
    """
    named = listed.toDF("_listed")
    seen = named.agg(F.count(F.lit(1)).alias("n"), F.count("_listed").alias("filled")).first()
    if not seen["n"]:
        return df
    if seen["filled"] < seen["n"]:
        return df.filter(F.lit(False))
    return df.filter(F.col(column).isNotNull()).join(named, F.col(column) == F.col("_listed"), "left_anti")


def history(df: DataFrame, keys: Sequence[str], valid_from: str) -> DataFrame:
    """Slowly changing dimension, type 2: valid_to is the next version's start, null for the current one."""
    following = F.lead(valid_from).over(Window.partitionBy(*keys).orderBy(valid_from))
    return df.withColumn("valid_to", following).withColumn("is_current", F.col("valid_to").isNull())


def scd2_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """A full load ``new`` merged into versions ``old`` (columns of ``new``, valid_from, valid_to).

    A current version whose key is gone or whose values differ ends at ``at``; changed and new keys
    get a version from ``at`` on. The same load again changes nothing.
    """
    columns = new.columns
    current, past = old.filter("valid_to is null"), old.filter("valid_to is not null")
    ended = without_keys(current, new, columns).withColumn("valid_to", at)
    kept = without_keys(current, ended, columns)
    added = without_keys(last_written(new, keys), kept, columns).withColumn("valid_from", at).withColumn("valid_to", F.lit(None).cast(old.schema["valid_to"].dataType))
    return past.unionByName(ended).unionByName(kept).unionByName(added)


# --- completion metrics ---------------------------------------------------------------


def completion(df: DataFrame, keys: Sequence[str], done: Column, digits: int = 1) -> DataFrame:
    """total, done and pct a key (or overall): rows for which ``done`` is not null."""
    total, finished = F.count(F.lit(1)), F.count(done)
    pct = F.round((F.lit(100.0) * finished / F.nullif(total, F.lit(0))).cast("double"), digits)
    return df.groupBy(*keys).agg(total.alias("total"), finished.alias("done"), pct.alias("pct"))


def span_shortfall(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Numbers expected between the smallest and largest of a key, present, and missing."""
    expected = F.max(number) + 1 - F.min(number)
    present = F.count_distinct(number)
    return df.groupBy(*keys).agg(expected.cast("long").alias("expected"), present.alias("present"), (expected - present).cast("long").alias("missing"))


def decode_fragments(codes: DataFrame, code: str, dictionary: DataFrame, width: int = 3) -> DataFrame:
    """Labels for composite codes.

    A code that the dictionary (code, label, kind, priority) knows as a whole gets its best label; else its
    fragments of ``width`` characters do, unknown ones in brackets, joined by " · "; a length that the
    width does not divide leaves the bracketed code. Returns code, label and parts (JSON).
    """
    distinct = codes.select(F.col(code).alias("code")).filter(F.col("code") != "").distinct()
    best = keep_first(dictionary, ["code"], [F.asc_nulls_last("priority"), F.asc("kind"), F.asc("label")]).select("code", "label", "kind")
    best = small_side(best)
    whole = distinct.join(best, "code")
    whole = whole.select("code", "label", F.to_json(F.array(F.struct(F.lit(1).alias("position"), F.col("code").alias("fragment"), "kind", "label")), {"ignoreNullFields": "false"}).alias("parts"))
    rest = distinct.join(whole.select("code"), "code", "left_anti")
    divisible = (F.length("code") % width == 0) & (F.length("code") > 0)
    n = (F.length("code") / width).cast("int")
    pieces = rest.filter(divisible).withColumn("position", F.explode(F.sequence(F.lit(1), n)))
    pieces = pieces.withColumn("fragment", F.substring(F.col("code"), (F.col("position") - 1) * width + 1, F.lit(width)))
    known = pieces.join(best.withColumnRenamed("code", "fragment"), "fragment", "left")
    item = F.struct("position", "fragment", "kind", "label")
    gathered = known.groupBy("code").agg(F.array_sort(F.collect_list(item)).alias("items"))
    shown = F.array_join(F.transform("items", lambda x: F.coalesce(x["label"], F.concat(F.lit("["), x["fragment"], F.lit("]")))), " · ")
    split = gathered.select("code", shown.alias("label"), F.to_json("items", {"ignoreNullFields": "false"}).alias("parts"))
    unknown = rest.filter(~divisible).select("code", F.concat(F.lit("["), "code", F.lit("]")).alias("label"), F.lit(None).cast("string").alias("parts"))
    return whole.unionByName(split).unionByName(unknown)
