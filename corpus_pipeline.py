"""From documents to packed training sequences, a stage an operator.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept,
and returns rows with the columns of ``docs``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from millrace.llm.common import reliable_checkpoint, table


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; ``lang`` becomes the identified one.

    Null and empty texts are in none; repeated rows are judged one by one; an empty table stays empty.
    """
    return language_id.keep_identified(docs)


def strip_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line windows go, and documents of which nothing but white space is left.

    Null text becomes empty text; of equal windows the first in (doc_id, position) order stays, rows
    equal in id and text are one document; an empty table stays empty.
    """
    stripped = line_dedup.dedup_lines(docs)
    kept, removed = stripped.columns[: len(docs.columns)], stripped.columns[-1]
    left = stripped.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return _sized(left.select(*kept))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id.

    Null and empty texts are each alone; null ids come last; of rows equal in id and text one stays;
    an empty table stays empty.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none; repeated rows go or stay together; without documents or items
    nothing goes.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 1,024 tokens.

    Null text is empty text, a piece that holds the end id; repeated rows are packed one by one; an
    empty table gives no rows.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", strip_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack_sequences),
]

#: Trained models, signatures and tokens are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = reliable_checkpoint(docs)
    return docs
