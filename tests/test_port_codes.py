"""Code list, boxes and centres against plain Python; file ages on written folders."""

import csv
import math
import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators.spatial import box_pairs, in_any_box
from tidewater.plans import features as FT
from tidewater.sources import file_ages as FA
from tidewater.sources import port_codes as PC

ROWS = [
    ["", "NL", "RTM", "Rotterdam", "Rotterdam", "ZH", "12345---", "AF", "0401", "", "5155N 00430E", ""],
    ["+", "AR", "BUE", 'Buenos "Aires", south', "x", "", "1-------", "AF", "0401", "", "3436S 05822W", "a,b"],
    ["", "NL", "RTM", "again", "x", "", "1-------", "AF", "0401", "", "5200n 00400e", ""],
    ["", "US", "XXX", "no sea", "x", "", "--34----", "AF", "0401", "", "4000N 07000W", ""],
    ["", "US", "NOC", "no place", "x", "", "1-------", "AF", "0401", "", "", ""],
    ["", "US", "BAD", "bad", "x", "", "1-------", "AF", "0401", "", "4A00N 07000W", ""],
    ["", "US", "ONE", "one part", "x", "", "1-------", "AF", "0401", "", "4000N", ""],
    ["", "US", "SHO", "short", "x", "", "1-------", "AF", "0401", "", "40N 070W", ""],
    ["", "US", "", "no code", "x", "", "1-------", "AF", "0401", "", "4000N 07000W", ""],
    ["", " GL", "POL ", "far north", "x", "", "1-------", "AF", "0401", "", " 8959N   00000E ", ""],
]


def python_ports():
    for r in ROWS:
        parts = r[10].strip().split()
        if "1" not in r[6] or len(parts) != 2:
            continue
        try:
            lat = float(parts[0][:2]) + float(parts[0][2:4]) / 60
            lon = float(parts[1][:3]) + float(parts[1][3:5]) / 60
        except ValueError:
            continue
        yield r[1].strip(), r[2].strip(), -lat if parts[0][-1].upper() == "S" else lat, -lon if parts[1][-1].upper() == "W" else lon


@pytest.fixture
def rows(spark, tmp_path):
    path = tmp_path / "codes.csv"
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows(ROWS)
    return PC.scan_locode_csv(spark, str(path))


def test_scan(rows):
    got = [r.asDict() for r in rows.orderBy("row_order").drop("row_order").collect()]
    assert [list(r.values()) for r in got] == ROWS


def test_boxes_and_centres(rows):
    d = 50 / 60
    want = sorted((c + p, round(la - d, 4), round(la + d, 4), round(lo - d / max(math.cos(math.radians(la)), 0.1), 4),
                   round(lo + d / max(math.cos(math.radians(la)), 0.1), 4)) for c, p, la, lo in python_ports())
    assert sorted((r.locode, r.lat_min, r.lat_max, r.lon_min, r.lon_max) for r in PC.port_boxes(rows).collect()) == want
    assert [r.locode for r in PC.port_boxes(rows, ["ARBUE", "USXXX"]).collect()] == ["ARBUE"]
    centres = {c + p: (round(la, 4), round(lo, 4)) for c, p, la, lo in python_ports() if c and p}
    assert {r.locode: (r.lat, r.lon) for r in PC.port_centres(rows).collect()} == centres
    assert centres["NLRTM"] == (52.0, 4.0)  # the last row


def test_last_row_wins_over_splits(spark, tmp_path):
    """Many splits of two files: the order is that of the files and of the bytes in them."""
    for name, shift in (("a.csv", 0), ("b.csv", 5)):
        with (tmp_path / name).open("w") as f:
            for i in range(4000):
                f.write(f",NL,C{i % 50:02d},n,n,,1,AF,0401,,{(i // 100 + shift) % 80:02d}{i % 60:02d}N 004{i % 60:02d}E,\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        scanned = PC.scan_locode_csv(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 8
        got = {r.locode: r.lat for r in PC.port_centres(scanned).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {f"NLC{i % 50:02d}": round((i // 100 + 5) % 80 + i % 60 / 60, 4) for i in range(4000)}
    assert got == want


def test_points_in_boxes(spark):
    boxes = PC.capture_boxes(FT.ports_frame(spark).select("port_code", "lat", "lon"))
    points = spark.range(40000).select("id", (F.col("id") % 200 / 100 + 50.9).alias("lat"), (F.floor(F.col("id") / 200) / 50 + 2.0).alias("lon"))
    held = boxes.collect()
    want = {(r.id, b.port_code) for r in points.collect() for b in held if b.lat_min <= r.lat <= b.lat_max and b.lon_min <= r.lon <= b.lon_max}
    assert {(r.id, r.port_code) for r in box_pairs(points, boxes).collect()} == want and len(want) > 1000
    assert {r.id for r in in_any_box(points, boxes).collect()} == {i for i, _ in want}


def test_file_ages(spark, tmp_path):
    def put(source, day, name, age_minutes, now=1_714_600_000):
        folder = tmp_path / f"source={source}" / f"date={day}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("{}")
        os.utime(folder / name, (now - age_minutes * 60,) * 2)

    put("ais", "2024-05-01", "a.ndjson", 30)
    put("ais", "2024-05-01", "b.ndjson", 10)
    put("ais", "2024-04-30", "c.ndjson", 1)  # newer, but today's partition has files
    put("ais", "2024-05-01", "d.txt", 0)
    put("weather", "2024-04-30", "a.jsonl", 300)
    put("tides", "2024-04-29", "a.jsonl", 5)  # neither today nor yesterday
    put("news", "2024-05-01", "a.json", -7)  # from the future: age 0
    now = F.timestamp_seconds(F.lit(1_714_600_000))
    got = {r.source: (r.date, r.age_minutes, r.freshness, r.status) for r in FA.file_freshness(
        spark, str(tmp_path), ["ais", "weather", "tides", "news", "none"], "2024-05-01", now).collect()}
    assert got == {"ais": ("2024-05-01", 10.0, "10 min ago", "active"), "weather": ("2024-04-30", 300.0, "5h ago", "stale"),
                   "tides": (None, None, "unavailable", "stale"), "news": ("2024-05-01", 0.0, "0 min ago", "active"),
                   "none": (None, None, "unavailable", "stale")}
    nothing = FA.file_freshness(spark, str(tmp_path / "no"), ["ais"], "2024-05-01", now).first()
    assert nothing.age_minutes is None and nothing.status == "stale"
