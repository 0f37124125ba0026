"""Weather and tide bodies: parallel arrays, bad predictions, error bodies."""

import json

from tidewater.sources.marine import parse_tides, unzip_weather


def bodies(spark, *rows):
    return spark.createDataFrame([(f"P{i}", r if r is None or isinstance(r, str) else json.dumps(r))
                                  for i, r in enumerate(rows)], "port_code string, body string")


def test_short_arrays_give_null(spark):
    got = unzip_weather(bodies(
        spark, {"hourly": {"time": ["2026-04-13T00:00", "2026-04-13T01:00"], "wave_height": [1.5], "wave_period": [7, 8, 9]}},
        {"hourly": {"time": []}}, {"hourly": {}}, {}, None, "{bad")).orderBy("port_code", "timestamp").collect()
    assert [(r.port_code, r.timestamp, r.wave_height_m, r.wave_period_s, r.swell_wave_height_m) for r in got] == [
        ("P0", "2026-04-13T00:00", 1.5, 7.0, None), ("P0", "2026-04-13T01:00", None, 8.0, None)]


def test_tides_reject_and_fail_by_port(spark):
    good = {"t": "2026-04-13 06:23", "v": "1.52", "type": "H"}
    bad = [{"t": "13.04.2026", "v": "1", "type": "H"}, {"t": "2026-04-13 06:23", "v": "x", "type": "L"},
           {"t": "2026-04-13 06:23", "v": "1", "type": "Q"}, {"v": "1", "type": "H"}, {"t": "2026-02-30 06:23", "v": "1", "type": "H"}]
    events, rejected, failed = parse_tides(bodies(
        spark, {"predictions": [good, *bad, {"t": "2026-04-13 12:00", "type": "L"}]}, {"error": {"message": "no data"}}, {}, None))
    assert [tuple(r) for r in events.orderBy("timestamp").collect()] == [
        ("P0", "2026-04-13T06:23:00", 1.52, "H"), ("P0", "2026-04-13T12:00:00", 0.0, "L")]
    assert rejected.count() == len(bad)
    assert [tuple(r) for r in failed.collect()] == [("P1", "no data")]
