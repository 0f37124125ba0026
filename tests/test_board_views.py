"""Board orders, filters, previews, overlays and source ages on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidewater.plans import board_views as BV


@pytest.fixture(scope="module")
def vessels(spark):
    rows = [("A", 1, "Zulu", "transit", 3, 40.0, 40.0, 0.0, 0.0), ("A", 2, "alpha", "berth", 0, 2.0, 2.0, 0.2, 0.2),
            ("A", 31, "Beta", "anchor", 1, 2.0, 2.0, None, 0.0), ("A", 4, "Beta", "anchor", 1, 2.0, 2.0, 0.0, 0.0),
            ("B", 5, "Rho", "approaching", 2, 30.0, 30.0, 10.0, 10.0), ("B", 6, "Tau", "transit", 3, 60.0, 60.0, 30.0, 30.0)]
    rows += [("C", 100 + i, f"N{i}", "transit", 3, 51.0 + i, 51.0 + i, 5.0, 5.0) for i in range(9)]
    return spark.createDataFrame(rows, "port_code string, mmsi long, name string, zone string, zone_priority int, "
                                       "distance_nm double, dist double, sog double, speed double")


def ids(df, rank, port):
    return [r.mmsi for r in df.filter(F.col("port_code") == port).orderBy(rank).collect()]


def test_orders(vessels):
    assert ids(BV.board_order(vessels), "board_rank", "A") == [2, 4, 31, 1]
    assert ids(BV.schedule_sort(vessels, "distance"), "sort_rank", "A") == [2, 4, 31, 1]
    assert ids(BV.schedule_sort(vessels, "name"), "sort_rank", "A") == [4, 31, 1, 2]  # code points: capitals first
    assert ids(BV.schedule_sort(vessels, "speed"), "sort_rank", "B") == [6, 5]
    assert ids(BV.schedule_sort(vessels, "eta"), "sort_rank", "B") == [6, 5]  # 2 h before 3 h
    assert ids(BV.schedule_sort(vessels, "eta"), "sort_rank", "A") == [1, 2, 4, 31]  # none makes way: ties by id
    with pytest.raises(ValueError):
        BV.schedule_sort(vessels, "size")


def test_filters(vessels):
    def got(**k):
        return sorted(r.mmsi for r in BV.board_filters(vessels, **k).filter("port_code <> 'C'").collect())
    assert got() == [1, 2, 4, 5, 6, 31]
    assert got(movement="inbound") == [1, 5, 6]
    assert got(zone="transit", movement="inbound", search=" TAU ") == [6]
    assert got(movement="waiting", search="3") == [31]
    assert got(zone="berth", movement="waiting") == []


def test_preview(vessels):
    rows = BV.preview(vessels).collect()
    assert {(r.port_code, r.hidden) for r in rows} == {("A", 0), ("B", 0), ("C", 3)}
    assert sum(r.port_code == "C" for r in rows) == 6
    assert BV.preview(vessels.limit(0)).count() == 0


def test_overlay(spark):
    covered = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "port_code string, port_name string")
    boards = spark.createDataFrame([("A", 4, 2, 1, 3.5, 0.5, 40), ("X", 1, 0, 0, 9.0, 0.0, 5)],
                                   "port_code string, tracked long, waiting long, berthed long, avg_speed double, "
                                   "max_wave double, congestion_pct int")
    got = {r.port_code: r for r in BV.coverage_overlay(covered, boards).collect()}
    assert (got["A"].has_snapshot, got["A"].tracked, got["A"].port) == (True, 4, "Alpha")
    assert (got["B"].has_snapshot, got["B"].tracked, got["B"].avg_speed) == (False, 0, 0.0)
    assert (got["X"].has_snapshot, got["X"].port) == (True, None)


def test_ages_and_alarms(spark):
    def frame(*times):
        return spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    frames = {"positions": frame("2026-05-02 08:29:00"), "news": frame("2026-05-01 00:00:00"),
              "old": frame("2026-04-30 23:59:59"), "none": frame()}
    now = F.lit("2026-05-02 10:00:00").cast("timestamp_ntz")
    f = BV.source_freshness(spark, dict.fromkeys(frames, "t"), frames, now)
    got = {r.source: r for r in f.collect()}
    assert (got["positions"].freshness, got["positions"].status, got["positions"].severe) == ("91 min ago", "active", False)
    assert (got["news"].freshness, got["news"].status, got["news"].severe) == ("1d ago", "stale", True)
    for name in ("old", "none"):
        assert (got[name].freshness, got[name].age_minutes, got[name].severe) == ("unavailable", None, True)
    assert {(r.source, r.alarm, r.breached) for r in BV.alarms(f).collect()} == {
        ("positions", "age_minutes", True), ("positions", "rows_per_hour", True), ("boards", "age_minutes", True)}
