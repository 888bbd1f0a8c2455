"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable_checkpoint(df: DataFrame, *, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with files that outlive any executor.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only
    where that is unset and the master is local (tests) a local folder is chosen.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-ckpt-"))
    return df.checkpoint(eager=eager)


def release_memory() -> None:
    """Give what this worker has freed back to the system: it lives on, beside the workers of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hash128(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: wrong matches need both to collide."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5DEECE66D), *reversed(columns))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``free_name`` of each."""
    return [free_name(df, w) for w in wanted]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no input column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
