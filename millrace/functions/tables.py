"""Python table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="item: string")
class SplitItems:
    """The filled, trimmed items of a delimited text, a row each; none for null."""

    def eval(self, text: str, separator: str):
        for item in (text or "").split(separator):
            if item.strip():
                yield (item.strip(),)


def register_split_items(spark: SparkSession, name: str = "split_items") -> None:
    spark.udtf.register(name, SplitItems)
