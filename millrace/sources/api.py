"""Answers of web APIs: nested JSON bodies to rows, and totals of what was polled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDICATOR = "array<struct<indicator:struct<id:string>,countryiso3code:string,country:struct<value:string>,date:string,value:double,unit:string,obs_status:string>>"


def indicator_rows(bodies: DataFrame) -> DataFrame:
    """Typed rows of [meta, records] pages.

    A page of one element is an error of an archived indicator and gives none; more than one page
    raises, as the others would be missed; records without a country code or with a bad year are skipped.
    """
    more = F.coalesce(F.get_json_object("body", "$[0].pages").try_cast("int"), F.lit(1)) > 1
    bodies = bodies.withColumn("body", F.when(more, F.raise_error(F.lit("more than one page of records"))).otherwise(F.col("body")))
    meta_ok = F.get_json_object("body", "$[1]").isNotNull()
    records = bodies.filter(meta_ok).select(F.explode(F.from_json(F.get_json_object("body", "$[1]"), INDICATOR)).alias("r"))
    rows = records.select(
        F.col("r.indicator.id").alias("indicator_code"),
        F.col("r.countryiso3code").alias("country_iso3"),
        F.col("r.country.value").alias("country_name"),
        F.col("r.date").try_cast("int").alias("year"),
        F.col("r.value").alias("value"),
        F.col("r.unit").alias("unit"),
        F.nullif(F.col("r.obs_status"), F.lit("")).alias("obs_status"),
    )
    return rows.filter((F.coalesce("country_iso3", F.lit("")) != "") & F.col("year").isNotNull())


def poll_totals(locations: DataFrame, country: str, order: str, valid: Column, *, cap: int) -> DataFrame:
    """country, polled, published and skipped: the first ``cap`` locations of each country by ``order``."""
    nth = F.row_number().over(Window.partitionBy(country).orderBy(order))
    polled = locations.withColumn("_nth", nth).filter(F.col("_nth") <= cap)
    good = F.coalesce(valid, F.lit(False))
    return polled.groupBy(country).agg(F.count(F.lit(1)).alias("polled"), F.count_if(good).alias("published"), F.count_if(~good).alias("skipped"))
