"""Board and prediction documents as nested JSON.

Everything that a document holds is bounded: ten ports, and the first ``LISTED`` vessels of each (a top-k of the reference that
is ranked before anything is gathered).  Null keys stay in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.functions.casts import safe_float
from tidewater.functions.rules import py_round
from tidewater.plans import board as BD

#: Vessels and arrivals listed per port (fixed value).
LISTED = 250
MODE = "batch-export"
KEEP_NULLS = {"ignoreNullFields": "false"}
#: Freshness source behind each board source, in the order of ``refdata.BOARD_SOURCES``.
SOURCES = ["positions", "weather", "tides", "news"]


def _time_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS 'UTC'")


def _listed(rows: DataFrame, rank: str, fields: list[Column], name: str) -> DataFrame:
    """One row per port: its rows as a list in the order of ``rank`` (at most ``LISTED``)."""
    lists = rows.groupBy("port_code").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_r"), F.struct(*fields).alias("v")))).alias("_l"))
    return lists.select("port_code", F.transform("_l", lambda x: x["v"]).alias(name))


def board_documents(ports: DataFrame, vessels: DataFrame, metrics: DataFrame, trend: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """port_code, port_idx and the port's board as a nested ``board`` value."""
    top = BD.vessel_list(vessels, limit=LISTED)
    ship = _listed(top, "list_rank", [
        F.col("name"), F.coalesce(F.col("mmsi").cast("string"), F.lit("")).alias("mmsi"),
        py_round(safe_float("lat"), 4).alias("lat"), py_round(safe_float("lon"), 4).alias("lon"), F.col("speed").alias("sog"),
        F.col("zone"), F.col("dist"), F.col("eta"), F.col("conf")], "_vessels")
    total = vessels.groupBy("port_code").agg(F.count("*").alias("_total"))
    schedule = _listed(BD.arrival_schedule(vessels, limit=LISTED), "schedule_rank",
                       [F.col(c) for c in ("vessel", "mmsi", "type", "status", "eta", "distance_nm")], "_schedule")
    berth = BD.berth_occupancy(metrics).withColumn("_no", F.substring_index("berth_id", "-", -1).cast("int"))
    berths = _listed(berth, "_no", [F.col("berth_id").alias("id"), F.col("name"), F.col("status")], "_berths")
    d = diagnostics.select("port_code", F.struct(
        "status", "message", "detail", _time_text("latest_within_50nm").alias("latestMessageWithin50nm"),
        _time_text("latest_within_200nm").alias("latestMessageWithin200nm"), F.col("messages_within_50nm").alias("messageCountWithin50nm"),
        F.col("messages_within_200nm").alias("messageCountWithin200nm"), F.col("messages_within_200nm").alias("providerMessageCount"),
        F.col("nearest_distance_nm").alias("nearestDistanceNm"), F.col("second_source_validation").alias("secondSourceValidation")).alias("_ais"))
    m = metrics.select("port_code", F.struct(
        F.col("congestion_pct").alias("congestionPct"), "waiting", F.col("avg_speed").alias("avgSpeed"), F.col("max_wave").alias("maxWave"),
        "tracked", "berthed").alias("_metrics"))
    j = reduce(lambda a, b: a.join(b, "port_code", "left"), [m, trend.select("port_code", "forecast", "trend"), d, total, ship, schedule, berths],
               ports)
    empty = {name: F.coalesce(F.col(name), F.array().cast(kind)) for name, kind in j.dtypes if name in ("_vessels", "_schedule", "_berths")}
    return j.select("port_code", "port_idx", F.struct(
        F.col("port_name").alias("name"), "flag", F.col("port_code").alias("code"), "lat", "lon", F.col("_metrics").alias("metrics"),
        "forecast", "trend", empty["_vessels"].alias("vessels"), F.coalesce("_total", F.lit(0)).alias("vesselsTotal"),
        F.col("_ais").alias("aisDiagnostics"), empty["_berths"].alias("berthAllocations"), empty["_schedule"].alias("schedule")).alias("board"))


def source_list(freshness: DataFrame) -> DataFrame:
    """One row: the board's sources with status, freshness, detail and contribution, in their fixed order."""
    fixed = freshness.sparkSession.createDataFrame(
        [(i, s, n, d, c) for i, (s, (n, _, d, c)) in enumerate(zip(SOURCES, R.BOARD_SOURCES, strict=True))],
        "_i int, source string, name string, detail string, contribution int")
    rows = fixed.join(freshness.select("source", "status", "freshness"), "source", "left")
    one = F.struct("_i", F.struct("name", F.coalesce("status", F.lit("stale")).alias("status"),
                                  F.coalesce("freshness", F.lit("unavailable")).alias("freshness"), "detail", "contribution").alias("v"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]).alias("sources"))


def board_payload(boards: DataFrame, labels: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """One row with the whole document as text (``document``): metadata, labels, sources, boards by port code."""
    by_port = boards.agg(F.array_sort(F.collect_list(F.struct("port_idx", "port_code", "board"))).alias("_p")).select(
        F.map_from_entries(F.transform("_p", lambda x: F.struct(x["port_code"], x["board"]))).alias("ports"))
    of_kind = {k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("position", "label")))) for k in ("trend", "outlook")}
    days = labels.agg(F.struct(*[F.transform(v, lambda x: x["label"]).alias(k) for k, v in of_kind.items()]).alias("labels"))
    meta = F.struct(F.date_format(as_of, "yyyy-MM-dd HH:mm 'UTC'").alias("generatedAt"), F.lit(MODE).alias("mode"))
    whole = by_port.join(days).join(sources)  # one row each
    return whole.select(F.to_json(F.struct(meta.alias("metadata"), "labels", "sources", "ports"), KEEP_NULLS).alias("document"))


def prediction_payload(scored: DataFrame, ports: DataFrame, as_of: Column) -> DataFrame:
    """One row with the predictions as text: a document per port in the ports' order, null for a port without data.

    ``scored``: port_code, congestion_probability (4 decimals), predicted_congested, as_of; ports without data are absent
    or null.
    """
    one = F.struct("port_code", F.col("predicted_congested").alias("prediction"), F.col("congestion_probability").alias("probability"),
                   F.date_format("as_of", "yyyy-MM-dd HH:mm:ss.SSS").alias("as_of"))
    rows = ports.select("port_code", "port_idx").join(scored, "port_code", "left").select(
        "port_idx", "port_code", F.when(F.col("congestion_probability").isNotNull(), one).alias("p"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("port_idx", "port_code", "p"))), lambda x: F.struct(x["port_code"], x["p"]))
    return rows.agg(F.map_from_entries(entries).alias("predictions")).select(
        F.to_json(F.struct(F.date_format(as_of, "yyyy-MM-dd HH:mm 'UTC'").alias("generatedAt"), "predictions"), KEEP_NULLS).alias("document"))


def sink_document(payload: DataFrame, path: str) -> None:
    """Write a document (one row) as one text file, in place of the one that was there."""
    payload.select("document").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.rtrim(F.regexp_replace("value", "\n$", "")).alias("document"))
