"""AIS envelope flattening: one payload, first non-empty key, defaults, ETA year."""

import json

from tidewater.sources.raw import flatten_positions, flatten_voyages

AT = "2026-06-15T12:00:00.000000+00:00"


def rows(spark, flatten, *messages):
    lines = [(i, m if isinstance(m, str) or m is None else json.dumps(m), AT) for i, m in enumerate(messages)]
    return flatten(spark.createDataFrame(lines, "event_id long, value string, received_at string")).collect()


def envelope(kind, message, **meta):
    return {"MessageType": kind, "MetaData": {"MMSI": 7, "ShipName": " EVER ", "latitude": 1.5, "longitude": 2.5, **meta},
            "Message": message}


def test_position_fields_come_from_one_payload(spark):
    got = rows(spark, flatten_positions,
               envelope("PositionReport", {"PositionReport": {"Latitude": 33.0}, "Sog": 7.0}),
               envelope("PositionReport", {"PositionReport": {"Sog": "bad", "SpeedOverGround": 4.0}}),
               envelope("PositionReport", {"PositionReport": {"Sog": "", "SpeedOverGround": "4.5", "TrueHeading": 90}}),
               envelope("1", {"Sog": 3.0, "Longitude": None}))
    assert [r.sog for r in got] == [0.0, 0.0, 4.5, 3.0]
    assert [r.lat for r in got] == [33.0, 1.5, 1.5, 1.5]
    assert [r.lon for r in got] == [2.5] * 4
    assert [r.true_heading for r in got] == [511, 511, 90, 511]
    assert {r.ship_name for r in got} == {"EVER"} and {r.nav_status for r in got} == {15}


def test_position_drops_other_types_and_bad_lines(spark):
    assert rows(spark, flatten_positions, envelope("ShipStaticData", {}), "{not json", None, "", "[]") == []


def test_voyage_columns_and_defaults(spark):
    full, bare = rows(spark, flatten_voyages, envelope("ShipStaticData", {"ShipStaticData": {
        "Name": " MAERSK ", "CallSign": "", "Callsign": "CS", "ImoNumber": 9321483, "Type": 70, "Destination": "  ",
        "MaximumStaticDraught": "x", "Draught": 9.0, "DimensionToBow": 5, "Dimension": {"A": 1, "B": 2}}}),
        envelope("StaticDataReport", {}))
    assert (full.ship_name, full.call_sign, full.imo_number, full.ship_type, full.destination) == (
        "MAERSK", "CS", "9321483", "70", "")
    assert full.draught_m is None
    assert (full.dimension_to_bow_m, full.dimension_to_stern_m, full.dimension_to_port_m) == (5, 2, None)
    assert bare.ship_name == "EVER" and bare.eta_raw is None and bare.eta_timestamp_utc is None
    assert len(bare) == 15


def test_eta_year_is_the_next_turn(spark):
    etas = [{"Month": 7, "Day": 1, "Hour": 5, "Minute": 30}, {"month": 1, "day": 2}, {"Month": 6, "Day": 15, "Hour": 12},
            {"Month": 0, "Day": 1}, {"Month": 2, "Day": 29}, {"Month": 7, "Day": 1, "Hour": 24}, {"Day": 1},
            "2026-07-01T05:00:00+02:00", "soon", ["x"]]
    got = rows(spark, flatten_voyages, *[envelope("VoyageData", {"VoyageData": {"Eta": e}}) for e in etas])
    assert [r.eta_timestamp_utc for r in got] == [
        "2026-07-01T05:30:00+00:00", "2027-01-02T00:00:00+00:00", "2026-06-15T12:00:00+00:00", None, None, None, None,
        "2026-07-01T03:00:00+00:00", None, None]
