"""What a board shows of a port's vessels: orders, filters, previews, berth use, source freshness and alarms.

All functions work on every port at once.  Ranks come from ``board.ranked``: ranges of the whole sort key, so no port is
sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.functions import rules
from tidewater.plans.board import berth_occupancy, ranked, vessel_list

PREVIEW = 6


def board_order(vessels: DataFrame) -> DataFrame:
    """Vessels of each port by zone (berth, anchor, approaching, transit), distance, name, then mmsi (T5)."""
    zone = rules.zone_ordinal("zone")
    return (ranked(vessels, [zone, "dist", "name", "mmsi"], "board_rank", None)
            .select("port_code", "board_rank", "mmsi", "name", "zone", "dist", rules.schedule_status("zone").alias("status")))


def schedule_sort(vessels: DataFrame, by: str) -> DataFrame:
    """Vessels of each port by distance, ETA hours, falling speed, or name (T6); ties by mmsi.

    Names compare by code points.  A vessel that makes no way has an infinite ETA and comes last.
    """
    orders: dict[str, Column] = {"distance": F.col("dist"), "eta": rules.eta_hours("dist", "speed"), "speed": F.col("speed").desc(),
                                 "name": F.col("name")}
    if by not in orders:
        raise ValueError(f"sort must be one of {sorted(orders)}")
    return ranked(vessels, [orders[by], F.col("mmsi")], "sort_rank", None)


def board_filters(vessels: DataFrame, zone: str = "all", movement: str = "all", search: str = "") -> DataFrame:
    """Vessels of a zone and a movement whose name or id holds the search text."""
    z = F.col("zone")
    moving = {"inbound": z.isin("approaching", "transit"), "waiting": z == "anchor", "berthed": z == "berth"}
    keep = [z == zone] if zone != "all" else []
    if movement in moving:
        keep.append(moving[movement])
    text = search.strip().lower()
    if text:
        keep.append(F.lower("name").contains(text) | F.col("mmsi").cast("string").contains(text))
    return reduce(DataFrame.filter, keep, vessels)


def preview(vessels: DataFrame, n: int = PREVIEW) -> DataFrame:
    """The first ``n`` vessels of each port's list and how many more there are."""
    return (vessel_list(vessels, limit=n)
            .withColumn("hidden", F.greatest(F.col("vessels_total") - n, F.lit(0)))
            .select("port_code", "list_rank", "mmsi", "name", "zone", "hidden"))


def berth_utilisation(metrics: DataFrame) -> DataFrame:
    """Occupied berths of each port in percent, halves up; 0 for a port without berths."""
    use = (berth_occupancy(metrics).groupBy("port_code")
           .agg(F.count_if(F.col("status") == "occupied").alias("occupied"), F.count("*").alias("berths")))
    n = F.coalesce("berths", F.lit(0))
    busy = F.coalesce("occupied", F.lit(0))
    return metrics.select("port_code").join(use, "port_code", "left").select(
        "port_code", busy.alias("occupied"), n.alias("berths"),
        F.floor(busy / F.greatest(n, F.lit(1)) * 100 + 0.5).cast("int").alias("berth_util_pct"))


def coverage_overlay(covered: DataFrame, boards: DataFrame) -> DataFrame:
    """All covered ports with the metrics of those that have a board, zeros and no snapshot for the others.

    A board of a port that is not covered stays.
    """
    marked = boards.withColumn("_snapshot", F.lit(True))
    joined = covered.select("port_code", F.col("port_name").alias("port")).join(marked, "port_code", "full_outer")
    numbers = ["tracked", "waiting", "berthed", "avg_speed", "max_wave", "congestion_pct"]
    return joined.select("port_code", "port", *[F.coalesce(c, F.lit(0).cast(boards.schema[c].dataType)).alias(c) for c in numbers],
                         F.coalesce("_snapshot", F.lit(False)).alias("has_snapshot"))


def source_freshness(spark, sources: dict[str, Column | str], frames: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Age of each source's newest row of today or yesterday: minutes, label, status, severity.

    ``sources``: name to its time column.  Only two days are read; a source without a row there is unavailable.  Each
    source is one aggregate over its own frame, with the rows of the last hour beside it.
    """
    day = F.to_date(as_of)
    parts = []
    for name, column in sources.items():
        t = F.col(column).cast("timestamp_ntz")
        recent = frames[name].filter((t >= F.date_sub(day, 1).cast("timestamp_ntz")) & (t <= as_of))
        parts.append(recent.agg(F.max(t).alias("newest"), F.count_if(t > as_of - F.expr("interval 1 hour")).alias("last_hour"))
                     .withColumn("source", F.lit(name)))
    seconds = F.timestamp_diff("SECOND", F.col("newest"), as_of)
    age = F.when(F.col("newest").isNotNull(), F.greatest(seconds / 60.0, F.lit(0.0)))
    out = reduce(DataFrame.union, parts).withColumn("age_minutes", age)
    out = out.withColumn("freshness", rules.freshness_label("age_minutes")) \
        .withColumn("status", rules.freshness_status("age_minutes"))
    hours = rules.freshness_age_hours("freshness")
    return out.select("source", "newest", "last_hour", "age_minutes", "freshness", "status", hours.alias("age_hours"),
                      rules.freshness_severe("status", hours).alias("severe"))


def alarms(freshness: DataFrame) -> DataFrame:
    """Age limits and the least rows of an hour, one row per alarm; missing data is a breach."""
    limits = freshness.sparkSession.createDataFrame(R.ALARM_LIMITS, "source string, alarm string, limit double")
    measured = F.when(F.col("alarm") == "age_minutes", F.col("age_minutes")).otherwise(F.col("last_hour").cast("double"))
    breached = F.when(F.col("alarm") == "age_minutes", F.col("measured") > F.col("limit")) \
        .otherwise(F.col("measured") < F.col("limit"))
    return (limits.join(freshness, "source", "left").withColumn("measured", measured)
            .select("source", "alarm", "limit", "measured", F.coalesce(breached, F.lit(True)).alias("breached")))
