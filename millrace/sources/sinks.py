"""Sinks: Parquet layouts, incremental strategies, monthly partitions, messages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.operators import relational as R
from millrace.sources import schema


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite", partitions: Sequence[str] = (), files: int | None = None, sort: Sequence[str] = (), rows_a_file: int | None = None) -> None:
    """Parquet with an optional partition layout, file count, clustering order and file size limit.

    With ``partitions`` an overwrite replaces only the partitions that ``df`` has;
    rows are shuffled by them first, so that each gets few files.
    """
    if files:
        df = df.repartition(files, *partitions) if partitions else df.repartition(files)
    elif partitions:
        df = df.repartition(*partitions)
    if sort:
        df = df.sortWithinPartitions(*partitions, *sort)
    writer = df.write.mode(mode)
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    if partitions:
        writer = writer.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _paths(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def recover(spark: SparkSession, path: str) -> None:
    """After a crash between the two moves of ``rewrite``: put the former table back."""
    fs, of = _paths(spark, path)
    if not fs.exists(of(path)) and fs.exists(of(f"{path}.former")):
        fs.rename(of(f"{path}.former"), of(path))


def rewrite(df: DataFrame, path: str) -> None:
    """Replace what is at ``path`` by ``df``, which may read from there.

    The new table is written beside the old one, which is moved aside before the new one takes its
    place and deleted last: at every moment one of them is whole, and ``recover`` finds it.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    fs, of = _paths(spark, path)
    fs.delete(of(f"{path}.former"), True)
    if fs.exists(of(path)) and not fs.rename(of(path), of(f"{path}.former")):
        raise OSError(f"could not move {path}")
    if not fs.rename(of(f"{path}.next"), of(path)):
        raise OSError(f"could not move {path}.next")
    fs.delete(of(f"{path}.former"), True)
    spark.catalog.refreshByPath(path)


def insert_through_staging(path: str, new: DataFrame, keys: Sequence[str]) -> int:
    """Insert rows whose key is not at ``path`` yet; how many.

    They are staged first, so that the count and the append read the same rows; the staging table is dropped.
    """
    spark, staging = new.sparkSession, f"{path}.staging"
    recover(spark, path)
    first = R.last_written(new, keys)
    added = R.without_keys(first, spark.read.parquet(path), keys) if exists(spark, path) else first
    added.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(new.schema).parquet(staging)
    staged.write.mode("append").parquet(path)
    inserted = staged.count()
    fs, of = _paths(spark, staging)
    fs.delete(of(staging), True)
    spark.catalog.refreshByPath(path)
    return inserted


def merge_into(path: str, new: DataFrame, strategy: str, keys: Sequence[str] = (), *, order: Sequence[str] = (), **interval) -> None:
    """Bring ``new`` into the Parquet table at ``path``.

    Strategies: replace, append, upsert (the last by ``order`` wins), insert_only, delete_insert,
    time_interval (column, start, end) and scd2 (at). Keys compare null-safe. A single
    writer is assumed.
    """
    spark = new.sparkSession
    recover(spark, path)
    if strategy == "append":
        new.write.mode("append").parquet(path)
    elif strategy == "insert_only":
        insert_through_staging(path, new, keys)
    elif strategy == "scd2":
        versions = new.withColumn("valid_from", interval["at"]).withColumn("valid_to", interval["at"])
        old = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], versions.schema)
        rewrite(R.scd2_merge(old, new, keys, interval["at"]), path)
    elif strategy == "replace" or not exists(spark, path):
        rewrite(R.last_written(new, keys, order) if strategy == "upsert" else new, path)
    else:
        old = spark.read.parquet(path)
        merged = {
            "upsert": lambda: R.upsert(old, new, keys, order),
            "delete_insert": lambda: R.delete_insert(old, new, keys),
            "time_interval": lambda: R.replace_interval(old, new, interval["column"], interval["start"], interval["end"]),
        }[strategy]()
        rewrite(merged, path)


def merge_nested(folder: str, nested: DataFrame, table: str, load_id: str, keys: Sequence[str], *, order: Sequence[str] = ()) -> dict[str, str]:
    """Merge nested documents into a tree of tables below ``folder``; the path of each table.

    A document replaces the one with its keys together with everything below it: of the children at any
    depth those whose root is loaded anew go and the new ones come, so that a list that has shrunk or is
    gone leaves nothing behind. A level is one anti join by root id and one union; columns that one side
    lacks are null. Of several documents with one key the last by ``order`` counts, with its children only.
    The same load again changes nothing but the load's id. Levels are written one after the other, the root
    last, so that a load that broke off is mended by the next one with the same documents.
    """
    spark = nested.sparkSession
    documents = evaluated_once(R.last_written(nested, keys, order), f"{folder}/.loads/{load_id}")
    new = schema.parent_and_children(documents, table, load_id, [schema.normalized_name(k) for k in keys])
    paths = {name: f"{folder}/{name}" for name in new}
    fs, of_path = _paths(spark, folder)
    there = [f.getPath().getName() for f in fs.listStatus(of_path(folder))]  # tables that this load has no rows for
    paths |= {name: f"{folder}/{name}" for name in there if name.startswith(f"{table}__") and not name.endswith((".next", ".former"))}
    roots = new[table].select("_dlt_id")
    for name in sorted(paths, reverse=True):
        recover(spark, paths[name])
        if not exists(spark, paths[name]):
            new[name].write.parquet(paths[name])
            continue
        old, of = spark.read.parquet(paths[name]), "_dlt_id" if name == table else "_dlt_root_id"
        kept = R.without_keys(old, roots.withColumnRenamed("_dlt_id", of), [of])
        rewrite(kept.unionByName(new[name], allowMissingColumns=True) if name in new else kept, paths[name])
    return paths


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int, *, bits: int = 8, rows_a_group: int = 100_000) -> None:
    """Parquet in which rows near in any of up to four columns lie near each other.

    Each column is cut into 2 ** ``bits`` ranks of about equal counts; the ranks' bits, interleaved from the
    highest down, are the row's place on a space-filling curve. Files are ranges of that place, sorted by it,
    so the statistics of files, row groups and pages are narrow in every column and a filter on any of them
    skips most. Null is the lowest rank.
    """
    if not 1 <= len(columns) <= 4:
        raise ValueError("one to four cluster columns")
    shares = [n / 2**bits for n in range(1, 2**bits)]
    places = {c: ordinal(df, c) for c in columns}
    cuts = df.agg(*(F.approx_percentile(places[c], shares, 100 * 2**bits).alias(f"c{i}") for i, c in enumerate(columns))).first()
    ranks = [rank_among(places[c], sorted(set(cuts[f"c{i}"] or ()))) for i, c in enumerate(columns)]
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for i in range(len(columns)):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(f"_rank{i}", bit).bitwiseAND(1), bit * len(columns) + len(columns) - 1 - i))
    ranked = df.withColumns({f"_rank{i}": r for i, r in enumerate(ranks)}).withColumn("_place", place).drop(*(f"_rank{i}" for i in range(len(columns))))
    sorted_ = ranked.repartitionByRange(files, "_place").sortWithinPartitions("_place").drop("_place")
    sorted_.write.mode("overwrite").option("parquet.block.row.count.limit", rows_a_group).option("parquet.page.row.count.limit", max(1, rows_a_group // 10)).parquet(path)


def ordinal(df: DataFrame, column: str) -> Column:
    """A column as a number of the same order: times by microseconds, texts by their first six bytes."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def rank_among(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending ``cuts`` are below ``value``, found in Arrow batches; 0 for null."""
    edges = np.array(cuts, float)

    @F.pandas_udf(LongType())
    def rank(values: pd.Series) -> pd.Series:
        numbers = values.to_numpy(dtype=float, na_value=-np.inf)
        return pd.Series(np.searchsorted(edges, np.where(np.isnan(numbers), np.inf, numbers), side="left"))

    return rank(value)


def evaluated_once(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a table below ``folder``: every later use reads what was computed once, even where it is random."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def monthly(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """A month column for partitioning; rows outside [first, last] go to the default partition (null)."""
    month = F.date_format(F.date_trunc("month", ts), "yyyy-MM")
    return df.withColumn("month", F.when(month.between(first, last), month))
