"""Freshness of sources by their files (S10, S11): the newest file of today's partition, else of yesterday's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import rules
from tidewater.sources.loader import list_files
from tidewater.sources.raw import source_path
from tidewater.sources.store import path_exists

GLOB = "*.{json,ndjson,jsonl}"


def newest_files(spark: SparkSession, root: str, sources: list[str], today: str, glob: str = GLOB) -> DataFrame:
    """source, date and newest file time: of today's partition, or of yesterday's where today's has no file; null without both.

    Two folders a source are listed, whatever history there is; no file is opened.
    """
    days = spark.createDataFrame([(today,)], "d string").select(F.to_date("d").alias("d")).select(
        F.date_format("d", "yyyy-MM-dd"), F.date_format(F.date_sub("d", 1), "yyyy-MM-dd")).first()
    names = spark.createDataFrame([(s,) for s in sources], "source string")
    found = []
    for source in sources:
        for day in days:
            folder = f"{source_path(root, source)}/date={day}"
            if path_exists(spark, folder):
                found.append(list_files(spark, folder, glob).groupBy().agg(F.max("modified").alias("newest")).select(
                    F.lit(source).alias("source"), F.lit(day).alias("date"), "newest"))
    if not found:
        return names.select("source", F.lit(None).cast("string").alias("date"), F.lit(None).cast("timestamp").alias("newest"))
    # dates as text: the later of the two partitions that has a file
    newest = reduce(DataFrame.union, found).filter("newest is not null").groupBy("source").agg(F.max(F.struct("date", "newest")).alias("m"))
    return names.join(newest, "source", "left").select("source", F.col("m.date").alias("date"), F.col("m.newest").alias("newest"))


def file_freshness(spark: SparkSession, root: str, sources: list[str], today: str, now: Column | None = None, glob: str = GLOB) -> DataFrame:
    """Age in minutes of each source's newest file (0 at least, null without one), its label and status."""
    newest = newest_files(spark, root, sources, today, glob)
    moment = F.current_timestamp() if now is None else now
    seconds = (F.unix_micros(moment) - F.unix_micros("newest")) / 1e6
    age = F.when(F.col("newest").isNotNull(), F.greatest(seconds / 60.0, F.lit(0.0)))
    return newest.withColumn("age_minutes", age).withColumn("freshness", rules.freshness_label("age_minutes")) \
        .withColumn("status", rules.freshness_status("age_minutes"))
