"""Documents and safe casts against Python."""

import datetime as dt
import json
import math

from pyspark.sql import functions as F

from tidewater.functions.casts import safe_float, safe_int
from tidewater.plans import board as BD
from tidewater.plans import documents as DC
from tidewater.plans import features as FT

TEXTS = [None, "", "  ", "1", " -1.75 ", "+2.", ".5", "1e3", "1E-2", "1_000", "1__0", "_1", "1_", "nan", "-inf", "Infinity", "infinit", "1d", "2f",
         "0x10", "abc", "1 2", "--1", "9e18", "9.3e18", "1e400", "٣", "12kn", "-0.9", "\t7\n", "1e", "e1", ".", "1._5", "1.5_0"]


def python_float(text, default):
    try:
        return float(text) if text not in (None, "") else default
    except ValueError:
        return default


def python_int(text, default):
    try:
        n = int(float(text)) if text not in (None, "") else default
        return n if abs(n) < 9.2e18 else default
    except (ValueError, OverflowError):
        return default


def test_safe_casts(spark):
    texts = [t for t in TEXTS if t != "٣"]  # digits of other scripts are no numbers here
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", safe_float("t", 1.5).alias("f"), safe_int("t", 4).alias("n")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        want = python_float(t, 1.5)
        assert r.f == want or (math.isnan(r.f) and math.isnan(want)), t
        assert r.n == python_int(t, 4), t


def frames(spark, n):
    """One port with ``n`` vessels, the others empty."""
    ports = FT.ports_frame(spark)
    v = spark.range(n).select(
        F.lit("NLRTM").alias("port_code"), (100 + F.col("id")).alias("mmsi"), F.format_string('V"%d', "id").alias("name"),
        F.lit(51.123456789).alias("lat"), F.lit(4.00005).alias("lon"), F.lit(1.0).alias("sog"), F.lit(2).alias("zone_priority"),
        (F.col("id") / 10).alias("distance_nm"), (F.col("id") / 10).alias("dist"), F.lit(1.0).alias("speed"),
        F.lit("approaching").alias("zone"), F.lit("1h 00m").alias("eta"), F.lit(90).alias("conf"))
    metrics = ports.select("port_code", F.when(F.col("port_code") == "NLRTM", n).otherwise(0).alias("tracked"), F.lit(0).alias("waiting"),
                           F.lit(2).alias("berthed"), F.lit(0.0).alias("avg_speed"), F.lit(0.5).alias("max_wave"), F.lit(7).alias("congestion_pct"))
    trend = ports.select("port_code", F.array(F.lit(0.1)).alias("forecast"), F.array(F.lit(0.1)).alias("trend"))
    none = F.lit(None)
    ais = ports.select("port_code", F.lit("active").alias("status"), F.lit("m").alias("message"), F.lit("d").alias("detail"),
                       none.cast("timestamp_ntz").alias("latest_within_50nm"), F.lit(dt.datetime(2024, 5, 1, 10)).cast("timestamp_ntz").alias("latest_within_200nm"),
                       F.lit(0).alias("messages_within_50nm"), F.lit(3).alias("messages_within_200nm"), none.cast("double").alias("nearest_distance_nm"),
                       F.lit("required").alias("second_source_validation"))
    return ports, DC.board_documents(ports, v, metrics, trend, ais)


def test_board_document(spark, tmp_path):
    ports, boards = frames(spark, 260)
    as_of = F.lit("2024-05-01 10:20:30").cast("timestamp_ntz")
    fresh = spark.createDataFrame([("positions", "active", "3 min ago"), ("weather", "stale", "2h ago")], "source string, status string, freshness string")
    payload = DC.board_payload(boards, BD.day_labels(as_of, spark), DC.source_list(fresh), as_of)
    DC.sink_document(payload, str(tmp_path / "doc"))
    DC.sink_document(payload, str(tmp_path / "doc"))  # in place of the first
    doc = json.loads(DC.read_document(spark, str(tmp_path / "doc")).first().document)
    assert doc["metadata"] == {"generatedAt": "2024-05-01 10:20 UTC", "mode": DC.MODE}
    assert doc["labels"]["trend"][-2:] == ["Yesterday", "Today"] and len(doc["labels"]["outlook"]) == 5
    assert [(s["status"], s["freshness"], s["contribution"]) for s in doc["sources"]] == [
        ("active", "3 min ago", 55), ("stale", "2h ago", 30), ("stale", "unavailable", 15), ("stale", "unavailable", 10)]
    assert list(doc["ports"]) == [r.port_code for r in ports.orderBy("port_idx").collect()]
    board = doc["ports"]["NLRTM"]
    assert list(board) == ["name", "flag", "code", "lat", "lon", "metrics", "forecast", "trend", "vessels", "vesselsTotal", "aisDiagnostics",
                           "berthAllocations", "schedule"]
    assert board["vesselsTotal"] == 260 and len(board["vessels"]) == len(board["schedule"]) == DC.LISTED
    assert board["vessels"][10] == {"name": 'V"10', "mmsi": "110", "lat": 51.1235, "lon": 4.0, "sog": 1.0, "zone": "approaching", "dist": 1.0,
                                    "eta": "1h 00m", "conf": 90}
    assert board["aisDiagnostics"]["latestMessageWithin50nm"] is None and board["aisDiagnostics"]["nearestDistanceNm"] is None
    assert board["aisDiagnostics"]["latestMessageWithin200nm"] == "2024-05-01 10:00:00.000 UTC"
    assert [b["status"] for b in board["berthAllocations"]][:3] == ["occupied", "occupied", "available"]
    empty = doc["ports"]["TWKHH"]
    assert (empty["vessels"], empty["vesselsTotal"], empty["berthAllocations"], empty["schedule"]) == ([], 0, [], [])


def test_prediction_document(spark):
    ports = FT.ports_frame(spark)
    scored = spark.createDataFrame([("NLRTM", 0.5, 1, dt.datetime(2024, 5, 1, 10)), ("SGSIN", None, None, None)],
                                   "port_code string, congestion_probability double, predicted_congested int, as_of timestamp_ntz")
    text = DC.prediction_payload(scored, ports, F.lit("2024-05-01 11:00:00").cast("timestamp_ntz")).first().document
    doc = json.loads(text)
    assert doc["generatedAt"] == "2024-05-01 11:00 UTC" and len(doc["predictions"]) == 10
    assert doc["predictions"]["NLRTM"] == {"port_code": "NLRTM", "prediction": 1, "probability": 0.5, "as_of": "2024-05-01 10:00:00.000"}
    assert doc["predictions"]["SGSIN"] is None and doc["predictions"]["TWKHH"] is None
