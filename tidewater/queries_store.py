"""Registered queries of what is written and read back: raw files, loads, curated tables, documents."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.plans import news as NW
from tidewater.queries import finish, register
from tidewater.session import scratch_path
from tidewater.sources import loader as LD
from tidewater.sources import raw as RW
from tidewater.sources.derived import Inputs

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def raw_records(spark, sf_dir: str, source: str) -> DataFrame:
    """Records of a raw source with the keys of its schema and their ``date``, from the derived views."""
    inp = Inputs(spark, sf_dir)
    if source == "ais":
        return inp.positions.withColumn("received_at", F.date_format("received_at", ISO))
    if source == "ais_voyage":
        return RW.flatten_voyages(RW.envelopes_from_voyages(inp.positions)).withColumn("date", F.substring("received_at", 1, 10))
    if source == "weather":
        e = F.col("event_id")
        return inp.weather.select("event_id", "port_code", F.date_format("obs_hour", ISO).alias("timestamp"), "wave_height_m",
                                  (e % 360).cast("double").alias("wave_direction_deg"), (e % 20 / 2).alias("wave_period_s"),
                                  "wind_wave_height_m", F.lit(None).cast("double").alias("swell_wave_height_m"), "date")
    if source == "noaa_tides":
        stations = spark.createDataFrame(R.TIDE_STATIONS, "port_code string, station_id string")
        return inp.tides.join(stations, "port_code").select("port_code", "station_id", F.date_format("tide_ts", ISO).alias("timestamp"),
                                                            "tide_level_m", "tide_type", F.date_format("tide_ts", "yyyy-MM-dd").alias("date"))
    return NW.news_records(inp.news).withColumn("date", F.substring("fetched_at", 1, 10))


def _scanned(spark, sf_dir: str, source: str) -> DataFrame:
    """Records written below source= and date=, and read with the source's fixed columns."""
    records = raw_records(spark, sf_dir, source)
    root = scratch_path(spark, "raw")
    RW.sink_ndjson(records.select(*[c.split()[0] for c in RW.RAW_SCHEMAS[source].split(", ")], "date"), root, source)
    return finish(RW.scan_raw_json(spark, root, source))


@register("scan_raw_voyage")
def q_scan_voyage(spark, sf_dir):
    return _scanned(spark, sf_dir, "ais_voyage")


@register("scan_raw_weather")
def q_scan_weather(spark, sf_dir):
    return _scanned(spark, sf_dir, "weather")


@register("scan_raw_tides")
def q_scan_tides(spark, sf_dir):
    return _scanned(spark, sf_dir, "noaa_tides")


@register("scan_raw_news")
def q_scan_news(spark, sf_dir):
    return _scanned(spark, sf_dir, "gdelt_events")


@register("ingest_counts")
def q_ingest_counts(spark, sf_dir):
    """Counts of a news run, and of a second, smaller one into the same folder."""
    records, root = raw_records(spark, sf_dir, "gdelt_events"), scratch_path(spark, "counted")
    runs = [("all", records), ("labor", records.filter("query_name = 'labor'"))]
    rows = []
    for name, part in runs:
        c = RW.sink_counted(part, root, "gdelt_events", {"attributed": F.coalesce(F.col("port_code") != "", F.lit(False))})
        rows.append((name, c["records"], c["attributed"], c["files"] > 0))
    return spark.createDataFrame(rows, "run string, records long, attributed long, wrote_files boolean")


# --- loads ---------------------------------------------------------------------------------------------------------------

#: Table of a load, the view of its records, and the keys of a record.
LOADS = {
    "raw_ais_positions": ("ais", ["mmsi", "ship_name", "lat", "lon", "sog", "cog", "true_heading", "nav_status", "msg_type", "received_at"]),
    "raw_weather_observations": ("weather", ["port_code", "timestamp", "wave_height_m", "wave_period_s", "wave_direction_deg"]),
}


def drop_lines(records: DataFrame, keys: list[str], root: str, drop: str) -> None:
    """Records as lines of text below ``root/drop=<drop>``; some are cut short (7 of 350), some lose their first key."""
    e = F.col("event_id")
    rest = F.to_json(F.struct(*keys[1:]))
    whole = F.to_json(F.struct(*keys))
    line = F.when(e % 50 == 7, F.substring(whole, 1, 20)).when(e % 50 == 8, rest).otherwise(whole)
    records.select(line.alias("value")).write.text(f"{root}/drop={drop}")


def _two_drops(spark, sf_dir, table: str) -> str:
    """Loads after a first drop of files, after a second, and once more without new files."""
    view, keys = LOADS[table]
    records, src, target = raw_records(spark, sf_dir, view), scratch_path(spark, "drops"), scratch_path(spark, "loaded")
    for i, drop in enumerate(("a", "b")):
        drop_lines(records.filter(F.col("event_id") % 2 == i), keys, src, drop)
        LD.load_files(spark, src, target, table, glob="*.txt")
    LD.load_files(spark, src, target, table, glob="*.txt")
    return target


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps as plain UTC times."""
    return finish(df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]))


@register("load_incremental")
def q_load_incremental(spark, sf_dir):
    target = _two_drops(spark, sf_dir, "raw_ais_positions")
    return _plain(LD.read_table(spark, target, "raw_ais_positions"))


@register("load_incremental_weather")
def q_load_incremental_weather(spark, sf_dir):
    target = _two_drops(spark, sf_dir, "raw_weather_observations")
    return _plain(LD.read_table(spark, target, "raw_weather_observations"))


@register("load_manifest")
def q_load_manifest(spark, sf_dir):
    """Rows and rejected lines by load, from the manifest; the folders of the files that each load took."""
    m = LD.manifest(spark, _two_drops(spark, sf_dir, "raw_ais_positions"), "raw_ais_positions")
    return m.groupBy("load", F.regexp_extract("file", "/drop=([a-z]+)/", 1).alias("drop")).agg(
        F.sum("row_count").alias("rows"), F.sum("rejected_lines").alias("rejected"))


@register("load_rejects")
def q_load_rejects(spark, sf_dir):
    r = LD.read_rejects(spark, _two_drops(spark, sf_dir, "raw_ais_positions"), "raw_ais_positions")
    return r.groupBy("load", "reason", F.substring("line", 1, 8).alias("head")).agg(F.count("*").alias("lines"))


@register("load_full_reload")
def q_load_full_reload(spark, sf_dir):
    """A load of one drop, then a full reload of two drops that keeps the first seven minutes of every hour."""
    table = "raw_ais_positions"
    view, keys = LOADS[table]
    records, src, target = raw_records(spark, sf_dir, view), scratch_path(spark, "drops"), scratch_path(spark, "loaded")
    for i, drop in enumerate(("a", "b")):
        drop_lines(records.filter(F.col("event_id") % 2 == i), keys, src, drop)
        if drop == "a":
            LD.load_files(spark, src, target, table, glob="*.txt")
    LD.load_files(spark, src, target, table, glob="*.txt", truncate=True, sample_minutes=7)
    return _plain(LD.read_table(spark, target, table).drop("load"))


def _loaded(spark, records: DataFrame, table: str) -> DataFrame:
    src, target = scratch_path(spark, "drops"), scratch_path(spark, "loaded")
    records.write.json(src)
    LD.load_files(spark, src, target, table, glob="*.json")
    return _plain(LD.read_table(spark, target, table).drop("load"))


@register("load_mapped_news")
def q_load_news(spark, sf_dir):
    """News records: the map's date and link keys, no code and no place."""
    r = raw_records(spark, sf_dir, "gdelt_events").select("event_id", "date", F.col("url").alias("source_url"), F.lit("").alias("event_code"))
    return _loaded(spark, r, "raw_gdelt_events")


@register("load_mapped_trade")
def q_load_trade(spark, sf_dir):
    t = Inputs(spark, sf_dir).trade
    r = t.select(F.col("reporter"), F.col("cmd_code").alias("hs_code"), F.col("primary_value").alias("trade_value"),
                 F.date_format("period", "yyyyMM").alias("period"))
    return _loaded(spark, r, "raw_comtrade_flows")


@register("load_mapped_macro")
def q_load_macro(spark, sf_dir):
    """Macro values: a point stands for no value."""
    m = Inputs(spark, sf_dir).macro
    return _loaded(spark, m.select("series_id", F.col("obs_date").cast("string").alias("date"), F.col("value_text").alias("value")),
                   "raw_fred_indicators")


@register("list_sources")
def q_list_sources(spark, sf_dir):
    """Folders (source and date) that hold data files, of two raw sources and some files of another kind."""
    root = scratch_path(spark, "raw")
    for source in ("weather", "noaa_tides"):
        RW.sink_ndjson(raw_records(spark, sf_dir, source).select(*[c.split()[0] for c in RW.RAW_SCHEMAS[source].split(", ")], "date"),
                       root, source)
    spark.range(3).selectExpr("cast(id as string)").coalesce(1).write.text(f"{root}/source=weather/date=2000-01-01")
    files = LD.list_files(spark, root, "*.{json,ndjson,jsonl}").filter("bytes > 0")
    return files.select(F.regexp_extract("file", "source=([^/]+)", 1).alias("source"),
                        F.regexp_extract("file", "date=([^/]+)", 1).alias("date")).distinct()


# --- curated tables ------------------------------------------------------------------------------------------------------

from tidewater.plans import build as BU  # noqa: E402
from tidewater.plans import ml as ML  # noqa: E402

#: Folder of the last build of a session and an input, so that the queries that read tables back share one build.
_built: dict[tuple[str, str], str] = {}


def _build(spark, sf_dir: str) -> tuple[str, dict[str, int]]:
    inp, root = Inputs(spark, sf_dir), scratch_path(spark, "curated")
    rows = BU.Build(spark, root, inp.positions, inp.voyage, inp.weather, inp.news, inp.ports).run()
    _built[spark.sparkContext.applicationId, sf_dir] = root
    return root, rows


def _curated(spark, sf_dir: str, table: str) -> DataFrame:
    root = _built.get((spark.sparkContext.applicationId, sf_dir)) or _build(spark, sf_dir)[0]
    return BU.read_curated(spark, root, table)


@register("build_all")
def q_build_all(spark, sf_dir):
    """Rows of every curated table, in the order of their build."""
    rows = _build(spark, sf_dir)[1]
    return spark.createDataFrame([(i + 1, t, n) for i, (t, n) in enumerate(rows.items())], "step int, table_name string, rows long")


@register("curated_congestion_target")
def q_curated_target(spark, sf_dir):
    return finish(_curated(spark, sf_dir, "congestion_target"))


@register("curated_vessel_state")
def q_curated_state(spark, sf_dir):
    return finish(_curated(spark, sf_dir, "feature_vessel_state_hourly"))


@register("curated_port_status")
def q_curated_status(spark, sf_dir):
    return finish(_curated(spark, sf_dir, "feature_port_status_hourly"))


@register("curated_port_status_v2")
def q_curated_status_v2(spark, sf_dir):
    return finish(_curated(spark, sf_dir, "feature_port_status_hourly_v2"))


@register("curated_dataset_v1")
def q_curated_dataset(spark, sf_dir):
    """The training table of the built tables, written to one folder and read back."""
    d = ML.training_dataset(_curated(spark, sf_dir, "feature_port_status_hourly"), _curated(spark, sf_dir, "congestion_target"), R.FEATURES_V1)
    root = scratch_path(spark, "datasets")
    BU.sink_dataset(d, root, "v1")
    return finish(BU.read_dataset(spark, root, "v1"))


# --- documents -----------------------------------------------------------------------------------------------------------

from tidewater.functions.casts import safe_float, safe_int  # noqa: E402
from tidewater.plans import board as BD  # noqa: E402
from tidewater.plans import documents as DC  # noqa: E402
from tidewater.plans import features as FT  # noqa: E402
from tidewater.queries import Board, _freshness  # noqa: E402


def _boards(spark, sf_dir: str) -> tuple[Board, DataFrame]:
    b = Board(spark, sf_dir)
    diagnostics = BD.coverage_diagnostics(b.inp.positions, b.ports, as_of=b.as_of)
    return b, DC.board_documents(FT.ports_frame(spark), b.vessels, b.metrics, BD.trend_scores(b.trend, b.ports), diagnostics)


@register("board_documents")
def q_board_documents(spark, sf_dir):
    """Every port's board as JSON text."""
    return _boards(spark, sf_dir)[1].select("port_code", F.to_json("board", DC.KEEP_NULLS).alias("document"))


@register("board_payload")
def q_board_payload(spark, sf_dir):
    """The whole document, written as one file and read back."""
    b, boards = _boards(spark, sf_dir)
    payload = DC.board_payload(boards, BD.day_labels(b.as_of, spark), DC.source_list(_freshness(spark, sf_dir)), b.as_of)
    path = scratch_path(spark, "board") + "/latest.json"
    DC.sink_document(payload, path)
    return DC.read_document(spark, path)


@register("latest_per_port")
def q_latest_per_port(spark, sf_dir):
    b = Board(spark, sf_dir)
    return finish(ML.latest_per_port(b.status, R.FEATURES_V1))


def rule_scores(latest: DataFrame) -> DataFrame:
    """A fixed score in place of a model's, so that SQL can state the same: logistic in anchored vessels and waves."""
    x = F.coalesce("vessels_at_anchor", F.lit(0)) - 1 + F.coalesce("avg_wave_height_m", F.lit(0.0)) / 2
    p = 1 / (1 + F.exp(-x))
    return latest.select("port_code", F.round(p, 4).alias("congestion_probability"), (p >= 0.5).cast("int").alias("predicted_congested"),
                         F.col("observation_hour").alias("as_of"))


@register("prediction_payload")
def q_prediction_payload(spark, sf_dir):
    """Predictions of a fixed score, one port left out, written as one file and read back."""
    b = Board(spark, sf_dir)
    scored = rule_scores(ML.latest_per_port(b.status.filter("port_code <> 'TWKHH'"), R.FEATURES_V1))
    path = scratch_path(spark, "predictions") + "/latest.json"
    DC.sink_document(DC.prediction_payload(scored, b.ports, b.as_of), path)
    return DC.read_document(spark, path)


@register("safe_cast_results")
def q_safe_cast(spark, sf_dir):
    """Numbers of texts that are numbers, blanks, words and nulls."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    text = (F.when(e % 8 == 0, n).when(e % 8 == 1, F.concat(F.lit(" -"), n, F.lit(".75 "))).when(e % 8 == 2, F.lit(""))
            .when(e % 8 == 3, F.concat(n, F.lit("kn"))).when(e % 8 == 4, F.concat(n, F.lit("e1"))).when(e % 8 == 5, F.lit("n/a"))
            .when(e % 8 == 6, F.concat(F.lit("."), n)))
    events = Inputs(spark, sf_dir).table("events").select("event_id", text.alias("result"))
    return finish(events.select("event_id", safe_float("result").alias("as_float"), safe_float("result", -1.0).alias("or_minus_one"),
                                safe_int("result").alias("as_int"), safe_int("result", 7).alias("or_seven")))


# --- port codes, boxes, file ages ----------------------------------------------------------------------------------------

from tidewater.operators.spatial import in_any_box  # noqa: E402
from tidewater.sources import file_ages as FA  # noqa: E402
from tidewater.sources import port_codes as PC  # noqa: E402

BOM = "\ufeff"


def _code_list(spark, sf_dir: str) -> DataFrame:
    """A code list of the customers: repeated codes, several kinds of unusable rows; files in the order of the keys."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    country = F.concat(F.char(65 + n % 26), F.char(65 + (n * 7) % 26))
    location = F.when(k % 29 == 0, "").otherwise(F.concat(F.char(65 + k % 20), F.char(65 + (k * 3) % 20), F.lit("X")))
    coordinates = (F.when(k % 17 == 3, "").when(k % 17 == 5, "5A12N 00410E").when(k % 17 == 7, "5155N")
                   .otherwise(F.format_string("%02d%02d%s %03d%02d%s", k % 90, k % 60, F.when(k % 2 == 0, "N").otherwise("s"), k % 180,
                                              (k * 7) % 60, F.when(k % 3 == 0, "E").otherwise("W"))))
    function = F.when(k % 5 == 0, "--34----").when(k % 5 == 1, "123-----").otherwise("1-------")
    quoted = F.concat(F.lit('"'), F.concat(F.lit('Port ""'), k, F.lit('"", west')), F.lit('"'))
    line = F.concat_ws(",", F.lit(""), country, location, quoted, F.lit("x"), F.lit(""), function, F.lit("AF"), F.lit("0401"), F.lit(""), coordinates, F.lit(""))
    customers = Inputs(spark, sf_dir).table("customer")
    path = scratch_path(spark, "codes")
    first = customers.agg(F.min("c_custkey")).first()[0]
    (customers.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
     .select(F.when(k == first, F.concat(F.lit(BOM), line)).otherwise(line).alias("value")).write.text(path))
    return PC.scan_locode_csv(spark, path)


@register("port_code_boxes")
def q_port_code_boxes(spark, sf_dir):
    return finish(PC.port_boxes(_code_list(spark, sf_dir)))


@register("port_code_centres")
def q_port_code_centres(spark, sf_dir):
    return finish(PC.port_centres(_code_list(spark, sf_dir)))


@register("bbox_filter")
def q_bbox_filter(spark, sf_dir):
    """Positions inside the capture box of any port."""
    inp = Inputs(spark, sf_dir)
    boxes = PC.capture_boxes(inp.ports.select("lat", "lon"))
    return finish(in_any_box(inp.positions.select("event_id", "lat", "lon"), boxes))


@register("station_lookup")
def q_station_lookup(spark, sf_dir):
    """Hours of ports with a tide station, and the station; other ports give no rows."""
    b = Board(spark, sf_dir)
    stations = spark.createDataFrame(R.TIDE_STATIONS, "port_code string, station_id string")
    return b.inbound.select("port_code", "observation_hour").join(F.broadcast(stations), "port_code")


@register("file_freshness")
def q_file_freshness(spark, sf_dir):
    """Sources whose files were just written: which of two partitions was taken; one without files is unavailable."""
    root = scratch_path(spark, "raw")
    for source in ("weather", "noaa_tides"):
        RW.sink_ndjson(raw_records(spark, sf_dir, source).select(*[c.split()[0] for c in RW.RAW_SCHEMAS[source].split(", ")], "date"),
                       root, source)
    last = raw_records(spark, sf_dir, "weather").agg(F.date_add(F.max(F.to_date("date")), 1).cast("string")).first()[0]
    ages = FA.file_freshness(spark, root, ["weather", "noaa_tides", "gdelt_events"], last)
    return ages.select("source", "date", "status", (F.col("age_minutes") >= 0).alias("has_age"), F.col("freshness").endswith("min ago").alias("minutes"))
