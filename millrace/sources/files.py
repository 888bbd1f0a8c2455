"""File sources: Parquet, CSV, JSON, TSV by position, archives, partition trees."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, *paths: str, merge_schema: bool = False) -> DataFrame:
    """Files or globs; with ``merge_schema`` the union of the files' columns by name."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)


def csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, *, infer: bool = False, recursive: bool = False) -> DataFrame:
    """CSV with a header, compressed or not; all strings unless a schema is given or inferred."""
    reader = spark.read.option("header", "true").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", str(infer).lower())
    return reader.csv([paths] if isinstance(paths, str) else list(paths))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole JSON documents, each an object or an array of objects."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def external_csv(spark: SparkSession, view: str, path: str, schema: str, skip: int = 1) -> DataFrame:
    """A view over CSV files; surplus values are ignored."""
    options = f"path '{path}', header '{str(bool(skip)).lower()}', mode 'PERMISSIVE'"
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} ({schema}) USING csv OPTIONS ({options})")
    return spark.table(view)


# --- TSV by position ------------------------------------------------------------------


def tsv_by_position(lines: DataFrame, positions: dict[str, tuple[int, str]], line: str = "value") -> DataFrame:
    """Typed columns of headerless lines: name -> (index, type).

    Lines with too few fields drop out, empty fields are null, and a filled
    field that does not parse raises. No quoting: tabs always separate.
    """
    fields = F.split(line, "\t", -1)
    last = max(i for i, _ in positions.values())
    cell = lambda i: F.nullif(F.get(F.col("_f"), F.lit(i)), F.lit(""))
    wide = lines.select(fields.alias("_f")).filter(F.size("_f") > last)
    return wide.select(*(cell(i).cast(kind).alias(name) for name, (i, kind) in positions.items()))


def split_tone(tone: Column) -> Column:
    """tone, positive, negative and word_count of a comma-separated tone text; absent parts are null."""
    parts = F.split(F.coalesce(tone, F.lit("")), ",", -1)
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(at(0).cast("double").alias("tone"), at(1).cast("double").alias("positive"), at(2).cast("double").alias("negative"), at(6).cast("int").alias("word_count"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member and text of every member of the ZIP files; bytes that are not UTF-8 are replaced."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    yield pd.DataFrame({"path": [p] * len(names), "member": names, "text": [z.read(n).decode("utf-8", "replace") for n in names]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, member string, text string")


# --- partition trees ------------------------------------------------------------------


def year_list(spec: str) -> list[int]:
    """'2020,2022-2023' -> [2020, 2022, 2023]; an inverted range raises."""
    years: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        first, _, last = part.partition("-")
        lo, hi = int(first), int(last or first)
        if lo > hi:
            raise ValueError(f"inverted year range: {part}")
        years |= set(range(lo, hi + 1))
    if not years:
        raise ValueError("no years given")
    return sorted(years)


def partition_paths(root: str, **levels: Sequence) -> list[str]:
    """Every combination of Hive-style folders; an empty level raises."""
    for name, values in levels.items():
        if not values:
            raise ValueError(f"no values for {name}")
    return ["/".join([root.rstrip("/"), *(f"{k}={v}" for k, v in zip(levels, combo, strict=True))]) for combo in itertools.product(*levels.values())]


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those paths that exist: one listing for each parent folder, on the store's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    by_parent: dict[str, list[str]] = {}
    for p in paths:
        by_parent.setdefault(p.rstrip("/").rpartition("/")[0], []).append(p)
    found = set()
    for parent, own in by_parent.items():
        folder = jvm.org.apache.hadoop.fs.Path(parent)
        fs = folder.getFileSystem(conf)
        if fs.exists(folder):
            there = {status.getPath().getName() for status in fs.listStatus(folder)}
            found |= {p for p in own if p.rstrip("/").rpartition("/")[2] in there}
    return [p for p in paths if p in found]


def slots(spark: SparkSession, start: str, end: str, minutes: int = 15) -> DataFrame:
    """Every aligned slot from start to end, both included; unaligned ends raise."""
    frame = spark.range(1).select(F.lit(start).cast("timestamp").alias("a"), F.lit(end).cast("timestamp").alias("b"))
    off = F.unix_timestamp("a") % (60 * minutes) + F.unix_timestamp("b") % (60 * minutes)
    checked = frame.withColumn("a", F.when(off == 0, F.col("a")).otherwise(F.raise_error(F.lit("slots must be aligned")).cast("timestamp")))
    return checked.select(F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias("slot"))
