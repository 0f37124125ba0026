"""Folders of numbered versions with a commit log: what is not committed is not there.

A version is written first, its commit (one row in one file) last.  Readers take the commits, so they see whole versions or
none; a run that dies in between leaves files that nobody reads and that the next run of the same number overwrites.
One writer at a time, as for any folder of plain files.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "number long, first long, replaces boolean, rows long, files long, committed_at timestamp"


@dataclass(frozen=True)
class Store:
    """Versions below ``root``.  A commit covers the numbers ``first`` to ``number``; one that ``replaces`` hides all before it."""

    spark: SparkSession
    root: str

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def commits(self) -> DataFrame:
        """All commits (one small row each)."""
        return read_or_empty(self.spark, self.path("commits"), COMMIT)

    def span(self) -> tuple[int, int] | None:
        """First and last committed number that count now; None before any commit."""
        c = self.commits()
        last = c.agg(F.max("number").alias("last"), F.max(F.when(F.col("replaces"), F.col("first"))).alias("first"),
                     F.min("first").alias("least")).first()
        if last["last"] is None:
            return None
        return int(last["least"] if last["first"] is None else last["first"]), int(last["last"])

    def next_number(self) -> int:
        span = self.span()
        return 1 if span is None else span[1] + 1

    def commit(self, number: int, first: int, replaces: bool, rows: int, files: int) -> None:
        row = [(number, first, replaces, rows, files, dt.datetime.now(dt.timezone.utc))]
        self.spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("append").parquet(self.path("commits"))

    def visible(self, folder: str, schema: str) -> DataFrame:
        """Rows of the versions that count, with their number in ``load`` (a partition column)."""
        span = self.span()
        rows = read_or_empty(self.spark, self.path(folder), f"{schema}, load long")
        return rows.filter(F.lit(False)) if span is None else rows.filter(F.col("load").between(*span))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet rows below a path; none if nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
