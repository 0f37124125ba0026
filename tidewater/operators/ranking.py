"""Ranks and running sums over a whole order, without one task that sees all rows.

Rows are dealt out by ranges of the full sort key, sorted inside each range and written once with their place
(``monotonically_increasing_id``: the range in its upper bits, the place in its lower 33).  What stands before a range follows
from a table of one row per range and group.  A group with most of the rows spreads over as many ranges as it needs; only
rows that are equal in the whole key stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import scratch_path

_PLACE_BITS = 33


def _in_order(df: DataFrame, keys: list, ranges: int | None) -> DataFrame:
    """The rows with ``_range`` and ``_place``, written to the shared scratch folder: ranges are sampled once."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    path = scratch_path(spark, "ranges")
    d.write.parquet(path)
    r = spark.read.schema(d.schema).parquet(path)
    return (r.withColumn("_range", F.shiftright("_id", _PLACE_BITS).cast("int"))
            .withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_id"))


def range_rank(df: DataFrame, groups: list[str], order: list, rank: str, ranges: int | None = None) -> DataFrame:
    """Row numbers (from 1) by ``order`` within each group of equal ``groups``, as the column ``rank``.

    ``order`` should tell all rows apart; rows that it doesn't are numbered in any order.  No group column may be null.
    """
    d = _in_order(df, [*[F.col(g) for g in groups], *order], ranges)
    counts = d.groupBy("_range", *groups).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *groups, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (d.join(offsets, ["_range", *groups])
            .withColumn(rank, F.col("_before") + F.col("_place") - F.col("_first") + 1)
            .select(*df.columns, rank))


def range_sums(df: DataFrame, order: list, sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Running sums by ``order`` over all rows, the own row included, as new columns."""
    d = _in_order(df.withColumns({f"_s_{k}": c for k, c in sums.items()}), order, ranges)
    totals = d.groupBy("_range").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = d.withColumns({f"_i_{k}": F.sum(f"_s_{k}").over(inside) for k in sums})
    return own.join(offsets, "_range").select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums])
