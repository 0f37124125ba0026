"""Loads and curated tables: what a crash, a repeat, a reload and a failed build leave behind."""

import pytest

from tests.conftest import SF_SMALL
from tidewater.plans import build as BU
from tidewater.sources import loader as LD
from tidewater.sources import raw as RW
from tidewater.sources.derived import Inputs
from tidewater.sources.store import Store

TABLE = "raw_ais_positions"


def line(mmsi, minute=0, key="received_at"):
    return f'{{"mmsi": {mmsi}, "{key}": "2024-05-01T10:{minute:02d}:00Z", "lat": "", "sog": null, "cog": 1.5}}'


def put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + ("\n" if lines else ""))


def ids(spark, target):
    return sorted(r.mmsi for r in LD.read_table(spark, str(target), TABLE).collect())


@pytest.fixture
def place(tmp_path):
    put(tmp_path / "raw" / "date=1", "a.ndjson", [line(1), "", "{cut", line(2)])
    put(tmp_path / "raw" / "date=2", "b.jsonl", [line(3), '{"lat": 1}', "[1]", line(4) + " x"])
    put(tmp_path / "raw" / "date=2", "empty.ndjson", [])  # not listed: it has no content yet
    put(tmp_path / "raw" / "date=2", "blank.ndjson", ["", " "])
    put(tmp_path / "raw" / "date=2", "notes.txt", [line(99)])
    return tmp_path / "raw", tmp_path / "out"


def test_second_load_adds_nothing(spark, place):
    src, out = map(str, place)
    assert LD.load_files(spark, src, out, TABLE) == LD.LoadResult(3, 3, 4)
    assert LD.load_files(spark, src, out, TABLE) == LD.LoadResult(0, 0, 0)
    assert ids(spark, out) == [1, 2, 3]
    m = {r.file.rsplit("/", 1)[1]: (r.row_count, r.rejected_lines, r["load"]) for r in LD.manifest(spark, out, TABLE).collect()}
    assert m == {"a.ndjson": (2, 1, 1), "b.jsonl": (1, 3, 1), "blank.ndjson": (0, 0, 1)}
    put(place[0] / "date=3", "c.ndjson", [line(5)])
    assert LD.load_files(spark, src, out, TABLE, max_files=1) == LD.LoadResult(1, 1, 0)
    assert ids(spark, out) == [1, 2, 3, 5]
    row = LD.read_table(spark, out, TABLE).filter("mmsi = 5").first()
    assert (row.latitude, row.speed_knots, row.course_deg, row["load"]) == (None, None, 1.5, 2)
    assert sorted((r.reason, r.line) for r in LD.read_rejects(spark, out, TABLE).collect()) == sorted(
        [("no json object", "{cut"), ("no mmsi,timestamp", '{"lat": 1}'), ("no json object", "[1]"), ("no json object", line(4) + " x")])


@pytest.mark.parametrize("where", ["data", "manifest", "commit"])
def test_crash_repeats_nothing(spark, place, monkeypatch, where):
    """A load that dies after any of its writes is not there, and the next one loads each row once."""
    src, out = map(str, place)
    put(place[0] / "date=0", "first.ndjson", [line(10)])
    if where == "manifest":
        real = LD.Observation.get  # read right after the manifest is written
        monkeypatch.setattr(LD.Observation, "get", property(lambda s: 1 / 0))
    elif where == "data":
        monkeypatch.setattr(LD, "data_schema", lambda t: 1 / 0)  # asked for once the rows are written
    else:
        monkeypatch.setattr(Store, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        LD.load_files(spark, src, out, TABLE)
    monkeypatch.undo()
    if where == "manifest":
        assert LD.Observation.get is real
    assert ids(spark, out) == [] and LD.manifest(spark, out, TABLE).count() == 0
    assert LD.load_files(spark, src, out, TABLE).rows == 4
    assert ids(spark, out) == [1, 2, 3, 10]


def test_reload_existing_and_truncate(spark, place, monkeypatch):
    src, out = map(str, place)
    LD.load_files(spark, src, out, TABLE, max_files=1)
    assert LD.load_files(spark, src, out, TABLE, reload_existing=True).files == 3
    assert ids(spark, out) == [1, 1, 2, 2, 3, 3] and LD.manifest(spark, out, TABLE).count() == 3
    put(place[0] / "date=4", "d.ndjson", [line(6, 9), line(7, 3), line(8, 30, "timestamp"), '{"mmsi": 9, "received_at": "x"}'])
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            LD.load_files(spark, src, out, TABLE, truncate=True, max_files=2)
    assert ids(spark, out) == [1, 1, 2, 2, 3, 3]  # the old table until the reload is whole
    LD.load_files(spark, src, out, TABLE, truncate=True, max_files=2, sample_minutes=5)
    assert ids(spark, out) == [1, 2, 3, 7]  # 6 came in minute 9; 8 has its time under another key, and no received_at
    assert LD.manifest(spark, out, TABLE).count() == 4
    assert LD.load_files(spark, src, out, TABLE).files == 0
    with pytest.raises(FileNotFoundError):
        LD.load_files(spark, src, out, TABLE, reload_existing=True, glob="*.nothing")
    assert LD.load_files(spark, src, out, TABLE, truncate=True, glob="*.nothing").files == 0
    assert ids(spark, out) == [] and LD.manifest(spark, out, TABLE).count() == 0


def test_minute_sample_keys(spark):
    """First of three keys that is not empty; numbers and short texts are no times, and such records stay."""
    records = ['{"mmsi":1,"received_at":"2024-05-01T10:30:00Z"}', '{"mmsi":2,"received_at":"","timestamp":"2024-05-01T10:30:00Z"}',
               '{"mmsi":3,"received_at":null,"time_utc":"2024-05-01T10:02:00Z"}', '{"mmsi":4,"received_at":1714550000000000}',
               '{"mmsi":5,"received_at":"2024-05-01"}', '{"mmsi":6}', '{"mmsi":7,"received_at":"2024-05-01T10:ab:00Z"}']
    lines = spark.createDataFrame([("f", r) for r in records], "file string, value string")
    kept = LD.mapped_lines(lines, "raw_fred_indicators", sample_minutes=5).count()
    assert kept == 5  # all but 1 and 2


def test_typed_columns_of_all_tables(spark):
    record = ('{"mmsi":"7","ship_name":"A","timestamp":"2024-05-01T10:00:00+02:00","received_at":"2024-05-01T10:00:00Z","lat":1,"port_code":"P",'
              '"wave_height_m":"1.5","event_id":"e","date":"2024-05-02","series_id":"s","value":".","reporter":"R","trade_value":"12"}')
    lines = spark.createDataFrame([("f", record)], "file string, value string")
    first = {t: LD.mapped_lines(lines, t).first() for t in LD.TABLE_TYPES}
    assert not any(r.rejected for r in first.values())
    assert first["raw_ais_positions"].mmsi == 7 and first["raw_ais_positions"].latitude == 1.0
    assert str(first["raw_weather_observations"].observation_hour) == "2024-05-01 08:00:00"
    assert str(first["raw_gdelt_events"].event_date) == "2024-05-02" and first["raw_fred_indicators"].value is None
    assert first["raw_comtrade_flows"].primary_value == 12.0


def test_empty_run_is_an_error(spark, tmp_path):
    none = spark.createDataFrame([], "a int, date string")
    with pytest.raises(ValueError):
        RW.sink_counted(none, str(tmp_path), "gdelt_events", {})
    with pytest.raises(ValueError):
        RW.sink_ndjson(none, str(tmp_path), "gdelt_events")


def build(spark, root, **extra):
    inp = Inputs(spark, SF_SMALL)
    frames = {"positions": inp.positions, "voyage": inp.voyage, "weather": inp.weather, "news": inp.news, "ports": inp.ports}
    return BU.Build(spark, str(root), **{**frames, **extra})


def test_build_in_order_and_failed_build(spark, tmp_path):
    first = build(spark, tmp_path)
    rows = first.run()
    assert list(rows) == BU.TABLES and all(first.table(t).count() == n for t, n in rows.items())
    assert dict(first.table("congestion_target").dtypes)["date_partition"] == "string"
    # raw frames are read by one table each; the others read what was written
    raw = {t: [f for f in step().inputFiles() if f.endswith("events.parquet")] for t, step in first.steps().items()}
    assert [t for t, files in raw.items() if files] == ["hourly_positions", "weather_hourly", "news_records", "feature_vessel_state_hourly"]
    assert "voyage" not in {t for t in raw} and len(first.steps()["feature_vessel_state_hourly"]().inputFiles()) == \
        1 + len(first.table("hourly_positions").inputFiles())
    half = build(spark, tmp_path, positions=first.positions.filter("event_id % 2 = 0"))
    half.steps_before = half.steps

    def broken():
        return {**BU.Build.steps(half), "congestion_target": lambda: 1 / 0}
    half.steps = broken
    with pytest.raises(ZeroDivisionError):
        half.run()
    assert first.table("congestion_target").count() == rows["congestion_target"]  # not reached: the old one
    assert first.table("hourly_positions").count() < rows["hourly_positions"]  # before it: the new one
    again = build(spark, tmp_path)
    assert again.run() == rows and {t: again.table(t).count() for t in BU.TABLES} == rows
    with pytest.raises(FileNotFoundError):
        BU.read_curated(spark, str(tmp_path), "no_such_table")


def test_literal_as_of_reaches_the_scan(spark):
    from tidewater.plans import features as FT
    pos = Inputs(spark, SF_SMALL).positions
    plan = FT.hourly_positions(pos, as_of="2024-01-30 00:00:00", lookback_days=2)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-28T00:00" in plan


def test_write_in_place(spark, tmp_path):
    """Rows are not moved before the write, and come back whole; the session's setting is as before."""
    df = spark.range(0, 900, 1, 3).selectExpr("id", "concat('2024-01-', lpad(cast(1 + id % 9 as string), 2, '0')) as date_partition")
    before = spark.conf.get(BU.WRITERS)
    assert BU.sink_curated(df, str(tmp_path), "t", in_place=True) == 900
    assert spark.conf.get(BU.WRITERS) == before
    back = BU.read_curated(spark, str(tmp_path), "t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert len(list((tmp_path / "t").glob("slot=*/date_partition=2024-01-01/*.parquet"))) == 3  # one of each task
    assert BU.sink_curated(df, str(tmp_path), "u") == 900
    assert len(list((tmp_path / "u").glob("slot=*/date_partition=2024-01-01/*.parquet"))) == 1
