"""Capture and live state: bad lines, replayed batches, late and older rows, silence."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater.plans import features as FT
from tidewater.streaming import capture as SC
from tidewater.streaming import live as LV

PORT = (51.9225, 4.4792)  # NLRTM


def position(mmsi, at, lat=PORT[0], lon=PORT[1], kind="PositionReport", sog=10.0, name=" A "):
    body = {"Latitude": lat, "Longitude": lon, "Sog": sog, "Cog": 12.4}
    return {"event_id": 1, "received_at": f"2024-05-01T{at}+00:00", "date": "2024-05-01",
            "value": json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "ShipName": name}, "Message": {kind: body}})}


def raw(value, at="10:00:00"):
    return {"event_id": 2, "received_at": f"2024-05-01T{at}+00:00", "date": "2024-05-01", "value": value}


class Feed:
    """Files in the order in which they come; a micro-batch takes one."""

    def __init__(self, root):
        self.src, self.n = root / "src", 0
        self.src.mkdir()

    def add(self, *rows):
        self.n += 1
        path = self.src / f"f{self.n}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        os.utime(path, (1_700_000_000 + self.n, 1_700_000_000 + self.n))


@pytest.fixture
def feed(tmp_path):
    return Feed(tmp_path)


VOYAGE = '{"MessageType":"5","MetaData":{"MMSI":7},"Message":{"Destination":" ROTTERDAM "}}'


def test_three_sinks_and_counts(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    feed.add(position(1, "10:00:00"), raw("{cut"), raw(VOYAGE), raw('{"MessageType":"PositionReport"}'))
    feed.add(position(1, "10:00:00"), position(2, "09:00:00", kind="StandardClassBPositionReport"), raw("[1]"), raw('{"MetaData":{"MMSI":1}}'),
             raw('{"MessageType":"Other"}'))
    SC.run_capture(spark, str(feed.src), out, str(tmp_path / "ckpt"), max_files=1)
    assert sorted((r.mmsi, r.received_at[11:19]) for r in SC.read_positions(spark, out).collect()) == [(1, "10:00:00"), (2, "09:00:00")]
    assert [(r.mmsi, r.destination) for r in SC.read_sink(spark, out, "voyage").collect()] == [(7, "ROTTERDAM")]
    assert sorted(r.value for r in SC.read_sink(spark, out, "quarantine").collect()) == sorted(
        ["{cut", '{"MessageType":"PositionReport"}', "[1]", '{"MetaData":{"MMSI":1}}'])
    c = SC.capture_counts(spark, out).first()
    assert (c.received, c.positions, c.voyage, c.quarantine, c.other) == (5, 3, 1, 4, 1)
    assert c.positions_files >= 2 and c.voyage_files == 1
    # nothing new: nothing happens; a late row of an earlier day stays
    SC.run_capture(spark, str(feed.src), out, str(tmp_path / "ckpt"), max_files=1)
    assert SC.capture_counts(spark, out).first().received == 5
    feed.add({**position(3, "10:00:00"), "received_at": "2024-04-01T10:00:00+00:00"})
    SC.run_capture(spark, str(feed.src), out, str(tmp_path / "ckpt"))
    assert SC.read_positions(spark, out).filter("mmsi = 3").first().date == "2024-04-01"
    assert SC.capture_counts(spark, out).first().received == 6


def test_replayed_batch_replaces_itself(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    rows = [position(1, "10:00:00"), raw("{cut"), raw(VOYAGE)]
    batch = spark.createDataFrame([(r["event_id"], r["value"], r["received_at"], r["date"]) for r in rows], SC.LINE_SCHEMA)
    for _ in range(3):
        SC.write_batch(batch, 0, out)
    SC.write_batch(batch, 1, out)  # the same messages again in another batch
    assert spark.read.parquet(f"{out}/messages").count() == 6
    assert SC.capture_counts(spark, out).first().received == 4
    assert SC.read_positions(spark, out).count() == 1 and SC.read_sink(spark, out, "voyage").count() == 1
    # a run from a lost checkpoint replays its batches onto the same folders
    feed.add(*rows)
    for ckpt in ("a", "b"):
        SC.run_capture(spark, str(feed.src), str(tmp_path / "again"), str(tmp_path / ckpt), max_files=1)
    assert SC.capture_counts(spark, str(tmp_path / "again")).first().received == 2


def live(spark, feed, tmp_path, **extra):
    out = str(tmp_path / "live")
    LV.run_live(spark, str(feed.src), FT.ports_frame(spark).select("port_code", "lat", "lon"), out, str(tmp_path / "live-ckpt"), max_files=1, **extra)
    return {(r.port_code, r.mmsi): r for r in LV.live_vessels(spark, out).collect()}


def test_live_state(spark, feed, tmp_path):
    feed.add(position(1, "10:00:00", sog=0.5, name=""), position(2, "10:00:00", lon=PORT[1] + 0.5), position(3, "10:00:00", lat=10.0),
             position(4, "10:00:00", kind="StandardClassBPositionReport"), raw("{cut"), position(1, "09:59:00", lat=52.0))
    feed.add(position(2, "10:04:00", lat=52.0), position(1, "10:01:00", lat=52.5, name=""))
    now = live(spark, feed, tmp_path, delay="10 minutes")
    # Antwerp's box holds Rotterdam, too; 3 is nowhere near, 4 is another message type
    assert {k for k in now if k[0] == "NLRTM"} == {("NLRTM", 1), ("NLRTM", 2)} and {k[1] for k in now} == {1, 2}
    one = now["NLRTM", 1]
    assert (one.name, one.lat, one.sog, one.cog, one.zone, one.conf, one.eta) == ("MMSI 1", 52.5, 10.0, 12.0, "transit", 100, "--:--")
    assert now["NLRTM", 2].lat == 52.0 and str(now["NLRTM", 2].last_seen) == "2024-05-01 10:04:00"
    # an older record comes late: nothing changes, and a replay of all files neither
    feed.add(position(2, "10:02:00", lat=51.5))
    assert live(spark, feed, tmp_path, delay="10 minutes") == now
    # silence: 1 was last seen at 10:01, 2 at 10:04; the clock goes to 10:08:30 and 10:20
    feed.add(position(5, "10:18:30"))  # the watermark comes ten minutes behind
    assert {k[1] for k in live(spark, feed, tmp_path, delay="10 minutes")} == {2, 5}
    feed.add(position(1, "10:19:30"), position(5, "10:30:00"))
    assert {k[1] for k in live(spark, feed, tmp_path, delay="10 minutes")} == {1, 5}  # 1 is back


def test_live_limit_is_five_minutes(spark, feed, tmp_path):
    """Five minutes to the second are still live, one millisecond more is not."""
    feed.add(position(1, "10:00:00"), position(2, "10:00:00.001"))
    feed.add(position(3, "10:05:00.001"))
    assert {k[1] for k in live(spark, feed, tmp_path)} == {2, 3}


def test_live_replay_from_the_start(spark, feed, tmp_path):
    feed.add(position(1, "10:00:00"), position(2, "10:01:00"))
    feed.add(position(1, "10:03:00", lat=52.0))
    first = live(spark, feed, tmp_path)
    out = str(tmp_path / "live")
    LV.run_live(spark, str(feed.src), FT.ports_frame(spark).select("port_code", "lat", "lon"), out, str(tmp_path / "other"), max_files=1)
    assert {(r.port_code, r.mmsi): r for r in LV.live_vessels(spark, out).collect()} == first
    assert spark.read.parquet(out).groupBy("batch_id", "port_code", "mmsi", "gone").count().filter(F.col("count") > 1).count() == 0
