"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each reads the driver tables of ``sf_dir`` (through the derived views) and
runs the library plan over the whole tables.  Output doubles are rounded to 6
decimals for the cross-engine check.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tidewater.plans import features as FT
from tidewater.plans import news as NW
from tidewater.session import written_once
from tidewater.sources.derived import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns for comparison with the oracle."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


class Graph:
    """Lazily built frames of the feature graph for one input directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.inp = Inputs(spark, sf_dir)
        self._c: dict[str, DataFrame] = {}

    def _get(self, key, build):
        if key not in self._c:
            self._c[key] = build()
        return self._c[key]

    def write_once(self, *names: str) -> Graph:
        """Write these frames and read them from there, for a query that needs them several times."""
        for name in names:
            self._c[name] = written_once(getattr(self, name), name)
        return self

    @property
    def as_of(self):
        return self._get("as_of", lambda: FT.as_of_column(None, self.inp.positions))

    @property
    def ports(self):
        return self.inp.ports

    @property
    def hourly(self):
        return self._get("hourly", lambda: FT.hourly_positions(self.inp.positions, as_of=self.as_of))

    @property
    def inbound(self):
        return self._get("inbound", lambda: FT.vessel_inbound_hourly(
            self.inp.positions, self.ports, as_of=self.as_of, hourly=self.hourly))

    @property
    def state(self):
        return self._get("state", lambda: FT.vessel_state_hourly(
            self.inp.positions, self.inp.voyage, self.ports, as_of=self.as_of))

    @property
    def news_records(self):
        return self._get("news", lambda: NW.news_records(self.inp.news))

    @property
    def attribution(self):
        return self._get("attr", lambda: FT.event_port_attribution_hourly(self.news_records))

    @property
    def signals(self):
        return self._get("signals", lambda: FT.event_signals_hourly(self.attribution))

    @property
    def weather_h(self):
        return self._get("weather_h", lambda: FT.weather_hourly(self.inp.weather, as_of=self.as_of))

    @property
    def status(self):
        return self._get("status", lambda: FT.port_status_hourly(self.inbound, self.weather_h, self.signals))

    @property
    def status_v2(self):
        return self._get("status_v2", lambda: FT.port_status_hourly_v2(self.state, self.weather_h, self.signals))

    @property
    def target(self):
        return self._get("target", lambda: FT.congestion_target(self.inbound, as_of=self.as_of))

    @property
    def target_thin(self):
        """Labels without the least number of anchored vessels: the derived feed is too thin for it to hold both classes."""
        return self._get("target_thin", lambda: FT.congestion_target(self.inbound, as_of=self.as_of, least_anchor=0))


@register("hourly_last_position")
def q_hourly_last_position(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return finish(FT.hourly_positions(g.inp.positions, extended=True, as_of=g.as_of))


@register("feature_vessel_inbound_hourly")
def q_inbound(spark, sf_dir):
    return finish(Graph(spark, sf_dir).inbound)


@register("feature_vessel_state_hourly")
def q_state(spark, sf_dir):
    return finish(Graph(spark, sf_dir).state)


@register("news_normalise")
def q_news(spark, sf_dir):
    return finish(Graph(spark, sf_dir).news_records)


@register("event_port_attribution_hourly")
def q_attr(spark, sf_dir):
    return finish(Graph(spark, sf_dir).attribution)


@register("feature_event_signals_hourly")
def q_signals(spark, sf_dir):
    return finish(Graph(spark, sf_dir).signals)


@register("feature_port_status_hourly")
def q_status(spark, sf_dir):
    return finish(Graph(spark, sf_dir).status)


@register("feature_port_status_hourly_v2")
def q_status_v2(spark, sf_dir):
    return finish(Graph(spark, sf_dir).status_v2)


@register("congestion_target")
def q_target(spark, sf_dir):
    return finish(Graph(spark, sf_dir).target)


# --- boards --------------------------------------------------------------------

from tidewater.plans import board as BD  # noqa: E402


class Board(Graph):
    @property
    def vessels(self):
        return self._get("vessels", lambda: BD.board_vessels(self.inp.positions, self.ports, as_of=self.as_of))

    @property
    def summary(self):
        return self._get("summary", lambda: BD.port_summary(self.inp.positions, self.inp.weather, self.ports,
                                                            as_of=self.as_of))

    @property
    def trend(self):
        return self._get("trend", lambda: BD.port_trend(self.inp.positions, self.inp.weather, self.ports,
                                                        as_of=self.as_of))

    @property
    def metrics(self):
        return self._get("metrics", lambda: BD.board_metrics(self.vessels, self.summary, self.ports))


VESSEL_COLS = ["port_code", "mmsi", "ship_name", "lat", "lon", "sog", "nav_status", "distance_nm", "received_at",
               "zone_priority", "dist", "speed", "zone", "eta", "conf", "name"]


@register("port_summary")
def q_port_summary(spark, sf_dir):
    return finish(Board(spark, sf_dir).summary)


@register("port_trend")
def q_port_trend(spark, sf_dir):
    return finish(Board(spark, sf_dir).trend)


@register("trend_scores")
def q_trend_scores(spark, sf_dir):
    b = Board(spark, sf_dir)
    return BD.trend_scores(b.trend, b.ports)


@register("board_vessels")
def q_board_vessels(spark, sf_dir):
    return finish(Board(spark, sf_dir).vessels.select(*VESSEL_COLS))


@register("vessel_list")
def q_vessel_list(spark, sf_dir):
    return finish(BD.vessel_list(Board(spark, sf_dir).vessels.select(*VESSEL_COLS)))


@register("arrival_schedule")
def q_arrival_schedule(spark, sf_dir):
    return finish(BD.arrival_schedule(Board(spark, sf_dir).vessels))


@register("board_metrics")
def q_board_metrics(spark, sf_dir):
    return finish(Board(spark, sf_dir).metrics)


@register("berth_occupancy")
def q_berth_occupancy(spark, sf_dir):
    return BD.berth_occupancy(Board(spark, sf_dir).metrics)


@register("zone_mix")
def q_zone_mix(spark, sf_dir):
    return finish(BD.zone_mix(Board(spark, sf_dir).vessels))


@register("distance_buckets")
def q_distance_buckets(spark, sf_dir):
    b = Board(spark, sf_dir)
    return BD.distance_buckets(b.vessels, b.ports)


@register("coverage_diagnostics")
def q_coverage(spark, sf_dir):
    b = Board(spark, sf_dir)
    return finish(BD.coverage_diagnostics(b.inp.positions, b.ports, as_of=b.as_of))


# --- spatial zones -----------------------------------------------------------------

from tidewater.operators import spatial as SP  # noqa: E402
from tidewater.plans import staging as ST  # noqa: E402
from tidewater.sources.geo import scan_geojson  # noqa: E402


@register("point_in_polygon")
def q_point_in_polygon(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    zones = scan_geojson(spark)
    hits = SP.within_zones(inp.positions.select("event_id", "mmsi", "lat", "lon"), zones)
    return finish(hits.select("event_id", "mmsi", "lat", "lon", "zone_ordinal", "zone_id", "zone_type"))


@register("best_zone")
def q_best_zone(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    pts = inp.positions.select("event_id", "mmsi", "lat", "lon")
    return finish(SP.best_zone(pts, scan_geojson(spark), ["event_id"]))


@register("distance_join")
def q_distance_join(spark, sf_dir):
    g = Graph(spark, sf_dir)
    sites = g.ports.select("port_code", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon"))
    pairs = SP.distance_join(g.inp.positions.select("event_id", "lat", "lon"), sites, 200.0)
    return finish(pairs.select("event_id", "port_code", "distance_nm"))


# --- staging, marts, quality -----------------------------------------------------

class Staging(Graph):
    @property
    def staged(self):
        return self._get("staged", lambda: ST.stage_positions(self.inp.positions, self.ports))

    @property
    def port_daily(self):
        return self._get("port_daily", lambda: ST.mart_port_daily(self.staged))


@register("stage_positions")
def q_stage_positions(spark, sf_dir):
    return finish(Staging(spark, sf_dir).staged.select("event_id", "mmsi", "received_at", "port_code",
                                                        "distance_nm", "zone"))


@register("stage_weather")
def q_stage_weather(spark, sf_dir):
    return finish(ST.stage_weather(Inputs(spark, sf_dir).weather))


@register("stage_trade")
def q_stage_trade(spark, sf_dir):
    return finish(ST.stage_trade(Inputs(spark, sf_dir).trade))


@register("stage_macro")
def q_stage_macro(spark, sf_dir):
    return finish(ST.stage_macro(Inputs(spark, sf_dir).macro))


@register("mart_port_daily")
def q_mart_port_daily(spark, sf_dir):
    return finish(Staging(spark, sf_dir).port_daily)


@register("mart_vessel_daily")
def q_mart_vessel_daily(spark, sf_dir):
    return finish(ST.mart_vessel_daily(Staging(spark, sf_dir).staged))


@register("quality_checks")
def q_quality(spark, sf_dir):
    g = Staging(spark, sf_dir)
    return ST.quality_checks(g.inp.positions, g.port_daily, ST.stage_macro(g.inp.macro), g.inp.weather, g.ports,
                             g.attribution, ST.stage_trade(g.inp.trade), g.as_of)


@register("point_in_time_join")
def q_point_in_time(spark, sf_dir):
    g = Graph(spark, sf_dir)
    labels = g.target.select("port_code", "observation_hour", "is_congested_24h")
    return finish(ST.point_in_time_features(labels, g.weather_h, ["avg_wave_height", "avg_wind_kn"]))


@register("hours_to_high_tide")
def q_tide(spark, sf_dir):
    g = Graph(spark, sf_dir)
    port_hours = g.inbound.select("port_code", "observation_hour").distinct()
    tides = g.inp.tides.select("port_code", F.col("tide_ts").cast("timestamp_ntz").alias("tide_ts"),
                               "tide_level_m", "tide_type")
    return finish(ST.hours_to_high_tide(port_hours, tides, ST.tide_stations(spark)))


@register("load_mapped")
def q_load_mapped(spark, sf_dir):
    pos = Inputs(spark, sf_dir).positions
    rec = pos.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return ST.load_mapped(rec, "raw_ais_positions", {"mmsi": "bigint", "latitude": "double", "longitude": "double",
                                                     "speed_knots": "double", "nav_status": "int"})


@register("load_minute_sample")
def q_minute_sample(spark, sf_dir):
    pos = Inputs(spark, sf_dir).positions
    rec = pos.select("event_id", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("received_at"))
    return ST.minute_sample(rec, 7)


# --- modelling -------------------------------------------------------------------

from tidewater import refdata as RD  # noqa: E402
from tidewater.plans import ml as ML  # noqa: E402


def _dataset_v1(g: Graph) -> DataFrame:
    return ML.training_dataset(g.status, g.target, RD.FEATURES_V1)


def _dataset_v2(g: Graph, thin: bool = False) -> DataFrame:
    return ML.dataset_v2(g.status_v2, g.target_thin if thin else g.target, g.as_of - F.make_dt_interval(F.lit(90)))


def _thin_v1(g: Graph) -> DataFrame:
    return ML.training_dataset(g.status, g.target_thin, RD.FEATURES_V1)


def _rule_score() -> Column:
    return F.least(F.lit(1.0), F.coalesce(F.col("vessels_at_anchor") / 4.0, F.lit(0.0)))


@register("dataset_v1")
def q_dataset_v1(spark, sf_dir):
    return finish(_dataset_v1(Graph(spark, sf_dir)))


@register("dataset_v2")
def q_dataset_v2(spark, sf_dir):
    return finish(_dataset_v2(Graph(spark, sf_dir)))


@register("daily_positive_rate")
def q_positive_rate(spark, sf_dir):
    return finish(ML.dataset_gate(_dataset_v2(Graph(spark, sf_dir))))


@register("chronological_split")
def q_chrono(spark, sf_dir):
    d = _dataset_v1(Graph(spark, sf_dir))
    return ML.chronological_split(d).groupBy("split").agg(F.count("*").alias("rows"),
                                                          F.min("observation_hour").alias("first_hour"),
                                                          F.max("observation_hour").alias("last_hour"))


@register("class_weight")
def q_class_weight(spark, sf_dir):
    d = ML.chronological_split(_dataset_v1(Graph(spark, sf_dir)))
    return finish(ML.class_weight(d.filter(F.col("split") == "train")))


@register("evaluate")
def q_evaluate(spark, sf_dir):
    """Metrics of a fixed score column (anchored share of the 10 nm ring) against the label."""
    d = _dataset_v1(Graph(spark, sf_dir))
    return finish(ML.evaluate(d.withColumn("score", _rule_score())))


@register("evaluate_two_classes")
def q_evaluate_two_classes(spark, sf_dir):
    """The same score against labels of both classes, from ten rings and speeds, so that most scores differ."""
    d = _thin_v1(Graph(spark, sf_dir))
    spread = F.coalesce(F.col("avg_speed_50nm") / 100, F.lit(0.0)) + F.col("vessels_in_200nm") / 1000
    return finish(ML.evaluate(d.withColumn("score", F.least(F.lit(1.0), _rule_score() + F.round(spread, 9)))))


@register("split_stratified")
def q_split_stratified(spark, sf_dir):
    d = ML.stratified_split(_thin_v1(Graph(spark, sf_dir)), ["port_code", "observation_hour"])
    return d.select("port_code", "observation_hour", RD.TARGET, "split")


@register("train_gbt_importance")
def q_train(spark, sf_dir):
    g = Graph(spark, sf_dir).write_once("inbound")
    d = ML.fill_features(ML.chronological_split(_dataset_v2(g, thin=True)), RD.FEATURES_V2)
    train = d.filter(F.col("split") == "train")
    model = ML.train_gbt(ML.with_weights(train, ML.positive_weight(train)), RD.FEATURES_V2, max_iter=150)
    return ML.importance(model, RD.FEATURES_V2, spark)


def _trained_v1(g: Graph, max_iter: int = 100):
    d = ML.fill_features(_thin_v1(g), RD.FEATURES_V1)
    train = ML.stratified_split(d, ["port_code", "observation_hour"]).filter(F.col("split") == "train")
    return ML.train_gbt(ML.with_weights(train, ML.positive_weight(train)), RD.FEATURES_V1, max_iter=max_iter)


@register("score_latest")
def q_score_latest(spark, sf_dir):
    g = Graph(spark, sf_dir).write_once("inbound", "status")
    return ML.score_latest(_trained_v1(g), g.status, g.ports, RD.FEATURES_V1)


@register("score_latest_rows")
def q_score_latest_rows(spark, sf_dir):
    """Which rows a model scores, and that its class follows from its probability; the probability itself is the model's."""
    g = Graph(spark, sf_dir).write_once("inbound", "status")
    scored = ML.score_latest(_trained_v1(g, max_iter=10), g.status, g.ports, RD.FEATURES_V1)
    p = F.col("congestion_probability")
    follows = (p == 0.5) | ((p > 0.5).cast("int") == F.col("predicted_congested"))
    return scored.select("port_code", "as_of", p.between(0, 1).alias("is_probability"), follows.alias("class_follows"))


@register("compare_models")
def q_compare_models(spark, sf_dir):
    """A v2 candidate and the saved v1 model on the same last hours (30 and 15 rounds)."""
    g = Graph(spark, sf_dir).write_once("inbound", "weather_h", "signals")  # read by both models' datasets
    serving, candidate = scratch_path(spark, "serving-v1"), scratch_path(spark, "candidate-v2")
    _trained_v1(g, max_iter=15).write().save(serving)
    return ML.compare_models(spark, _dataset_v2(g, thin=True), serving, candidate, max_iter=30)[0]


@register("label_fan_out")
def q_label_fan_out(spark, sf_dir):
    """Labels where an hour lies in two date partitions: derived by a second partition of every fifth hour."""
    g = Graph(spark, sf_dir)
    twice = g.inbound.filter(F.hour("observation_hour") % 5 == 0).withColumns({
        "date_partition": F.date_format(F.date_add(F.to_date("observation_hour"), 1), "yyyy-MM-dd"),
        "vessels_at_anchor": F.col("vessels_at_anchor") + 1})
    return finish(FT.congestion_target(g.inbound.union(twice), as_of=g.as_of, fan_out=True))


# --- raw sources, AIS flattening, streaming -----------------------------------------

from tidewater.session import scratch_path  # noqa: E402
from tidewater.sources import marine as MR  # noqa: E402
from tidewater.sources import raw as RW  # noqa: E402
from tidewater.streaming import capture as SC  # noqa: E402
from tidewater.streaming import live as LV  # noqa: E402

FLAT_COLS = ["mmsi", "ship_name", "lat", "lon", "sog", "cog", "true_heading", "nav_status", "msg_type", "received_at"]


@register("ais_position_flatten")
def q_ais_flatten(spark, sf_dir):
    env = RW.envelopes_from_positions(Inputs(spark, sf_dir).positions)
    return finish(RW.flatten_positions(env).select(*FLAT_COLS))


@register("ais_voyage_flatten")
def q_ais_voyage(spark, sf_dir):
    return finish(RW.flatten_voyages(RW.envelopes_from_voyages(Inputs(spark, sf_dir).positions)))


def _tide_bodies(spark, sf_dir):
    """Bodies of at most 1000 predictions from derived tides; every fifth is an error body."""
    t = Inputs(spark, sf_dir).tides.withColumn("body_no", F.floor(F.col("event_id") / 1000))
    one = F.struct(F.date_format("tide_ts", "yyyy-MM-dd HH:mm").alias("t"), F.col("tide_level_m").cast("string").alias("v"),
                   F.col("tide_type").alias("type"))
    b = t.groupBy("port_code", "body_no").agg(F.collect_list(one).alias("predictions"))
    error = F.to_json(F.struct(F.struct(F.concat(F.lit("no data in "), "body_no").alias("message")).alias("error")))
    return b.select("port_code", "body_no", F.when(F.col("body_no") % 5 == 0, error)
                    .otherwise(F.to_json(F.struct("predictions"))).alias("body"))


@register("tide_parse")
def q_tide_parse(spark, sf_dir):
    return finish(MR.parse_tides(_tide_bodies(spark, sf_dir))[0])


@register("tide_error_envelope")
def q_tide_errors(spark, sf_dir):
    return MR.parse_tides(_tide_bodies(spark, sf_dir))[2]


@register("weather_unzip")
def q_weather_unzip(spark, sf_dir):
    """Bodies of at most 1000 hours from derived weather; the second wave array is cut to half its length."""
    w = Inputs(spark, sf_dir).weather.withColumn("body_no", F.floor(F.col("event_id") / 1000))
    b = w.groupBy("port_code", "body_no").agg(F.sort_array(F.collect_list(F.struct(
        "event_id", F.date_format("obs_hour", "yyyy-MM-dd'T'HH:mm").alias("time"), "wave_height_m", "wind_wave_height_m")))
        .alias("h"))
    half = F.floor(F.size("h") / 2).cast("int")
    hourly = F.struct(F.col("h.time").alias("time"), F.col("h.wave_height_m").alias("wave_height"),
                      F.slice(F.col("h.wind_wave_height_m"), F.lit(1), half).alias("wind_wave_height"))
    return finish(MR.unzip_weather(b.select("port_code", "body_no", F.to_json(F.struct(hourly.alias("hourly"))).alias("body"))))


@register("scan_raw_json")
def q_scan_raw_json(spark, sf_dir):
    """Write derived positions as NDJSON (source/date layout), read back with the fixed schema and lookback."""
    g = Graph(spark, sf_dir)
    raw = g.inp.positions.select(*[c for c in FLAT_COLS if c != "received_at"],
                                 F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
                                 .alias("received_at"), "date")
    root = scratch_path(spark, "raw")
    RW.sink_ndjson(raw, root, "ais")
    scanned = RW.scan_raw_json(spark, root, "ais")
    as_of = F.lit(raw.agg(F.max("received_at")).first()[0][:10]).cast("date")
    return finish(scanned.filter(F.col("date") >= F.date_format(F.date_sub(as_of, 90), "yyyy-MM-dd")))


def _capture(spark, sf_dir):
    env = RW.envelopes_from_positions(Inputs(spark, sf_dir).positions)
    src = scratch_path(spark, "capture-src")
    env.write.json(src)
    out = scratch_path(spark, "capture-out")
    SC.run_capture(spark, src, out, scratch_path(spark, "capture-ckpt"))
    return out


@register("stream_capture")
def q_stream_capture(spark, sf_dir):
    out = _capture(spark, sf_dir)
    return finish(SC.read_positions(spark, out).select(*FLAT_COLS, "date"))


def _capture_all(spark, sf_dir) -> str:
    """A feed of positions, voyages, messages of another type, and lines that are cut short or have no vessel."""
    pos = Inputs(spark, sf_dir).positions
    e = F.col("event_id")
    feed = RW.envelopes_from_positions(pos).filter(e % 3 != 2).union(
        RW.envelopes_from_voyages(pos).filter((e % 3 == 2) & (e % 4 != 3)))
    text = (F.when(e % 50 == 7, F.substring("value", 1, 25)).when(e % 50 == 8, '{"MessageType":"PositionReport","Message":{}}')
            .when(e % 50 == 9, '{"MessageType":"Other","MetaData":{"MMSI":1}}').otherwise(F.col("value")))
    src, out = scratch_path(spark, "feed"), scratch_path(spark, "captured")
    feed.withColumn("value", text).write.json(src)
    SC.run_capture(spark, src, out, scratch_path(spark, "captured-ckpt"), max_files=3)
    return out


@register("stream_positions")
def q_stream_positions(spark, sf_dir):
    return finish(SC.read_sink(spark, _capture_all(spark, sf_dir), "positions").select(*FLAT_COLS, "date"))


@register("stream_voyages")
def q_stream_voyages(spark, sf_dir):
    return finish(SC.read_sink(spark, _capture_all(spark, sf_dir), "voyage"))


@register("stream_quarantine")
def q_stream_quarantine(spark, sf_dir):
    return SC.read_sink(spark, _capture_all(spark, sf_dir), "quarantine")


@register("stream_counts")
def q_stream_counts(spark, sf_dir):
    counts = SC.capture_counts(spark, _capture_all(spark, sf_dir))
    return counts.select("received", *SC.SINKS, "other", *[(F.col(f"{s}_files") > 0).alias(f"{s}_written") for s in SC.SINKS])


@register("stream_live_state")
def q_stream_live_state(spark, sf_dir):
    """Live vessels of the derived feed's end; silence of six hours, as the feed is thin."""
    inp = Inputs(spark, sf_dir)
    src, out = scratch_path(spark, "live-src"), scratch_path(spark, "live-out")
    RW.envelopes_from_positions(inp.positions).write.json(src)
    LV.run_live(spark, src, inp.ports, out, scratch_path(spark, "live-ckpt"), ttl_minutes=360)
    return finish(LV.live_vessels(spark, out))


@register("stream_hourly_features")
def q_stream_hourly(spark, sf_dir):
    out = _capture(spark, sf_dir)
    hourly = scratch_path(spark, "hourly-out")
    SC.run_hourly_features(spark, out, hourly, scratch_path(spark, "hourly-ckpt"))
    return finish(spark.read.parquet(hourly))


@register("port_ranking")
def q_port_ranking(spark, sf_dir):
    b = Board(spark, sf_dir)
    diagnostics = BD.coverage_diagnostics(b.inp.positions, b.ports, as_of=b.as_of)
    return finish(BD.port_ranking(b.metrics, b.ports, diagnostics))


@register("network_total")
def q_network_total(spark, sf_dir):
    """Vessels over all ports (A22): the sum of the ports' totals."""
    return Board(spark, sf_dir).vessels.agg(F.count("*").alias("tracked_vessels_total"))


@register("day_labels")
def q_day_labels(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return BD.day_labels(g.as_of, spark)


# --- what a board shows ---------------------------------------------------------------

from tidewater.plans import board_views as BV  # noqa: E402

SORTS = ["distance", "eta", "speed", "name"]
MOVEMENTS = ["all", "inbound", "waiting", "berthed"]


@register("board_order")
def q_board_order(spark, sf_dir):
    return finish(BV.board_order(Board(spark, sf_dir).vessels))


@register("schedule_sort")
def q_schedule_sort(spark, sf_dir):
    v = Board(spark, sf_dir).vessels
    return reduce(DataFrame.union, [BV.schedule_sort(v, by).select(F.lit(by).alias("sort_by"), "port_code", "sort_rank", "mmsi")
                                    for by in SORTS])


@register("board_filters")
def q_board_filters(spark, sf_dir):
    """Every movement, over all zones, with a search text."""
    v = Board(spark, sf_dir).vessels
    return reduce(DataFrame.union, [BV.board_filters(v, movement=m, search=" 1").select(F.lit(m).alias("movement"), "port_code",
                                                                                      "mmsi", "name", "zone")
                                    for m in MOVEMENTS])


@register("board_preview")
def q_board_preview(spark, sf_dir):
    return BV.preview(Board(spark, sf_dir).vessels)


@register("berth_utilisation")
def q_berth_utilisation(spark, sf_dir):
    return BV.berth_utilisation(Board(spark, sf_dir).metrics)


@register("coverage_overlay")
def q_coverage_overlay(spark, sf_dir):
    """Covered ports against boards of the ports with tracked vessels."""
    b = Board(spark, sf_dir)
    return finish(BV.coverage_overlay(b.ports, b.metrics.filter("tracked > 0")))


def _freshness(spark, sf_dir):
    g = Graph(spark, sf_dir)
    times = {"positions": "received_at", "weather": "obs_hour", "news": "fetched_at", "tides": "tide_ts"}
    return BV.source_freshness(spark, times, {k: getattr(g.inp, k) for k in times}, g.as_of)


@register("source_freshness")
def q_source_freshness(spark, sf_dir):
    return finish(_freshness(spark, sf_dir))


@register("source_alarms")
def q_source_alarms(spark, sf_dir):
    return finish(BV.alarms(_freshness(spark, sf_dir)))


from tidewater import queries_store as _queries_store  # noqa: E402,F401  registers its queries
