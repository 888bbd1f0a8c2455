"""Session settings the engine relies on, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "millrace", *, master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``master`` only where none is configured outside."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor sees: below ``spark.checkpoint.dir`` where that is set.

    Else below the context's checkpoint folder; a local folder only under a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and chosen.isDefined():
        root = chosen.get()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{root}/{purpose}-{uuid.uuid4().hex}"
