"""Loading, staging, marts and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.functions.geo import haversine_nm
from tidewater.functions.rules import live_zone
from tidewater.operators.spatial import nearest_in_reach
from tidewater.operators.temporal import asof_join

# --- Fixed values: loader column maps (source key -> warehouse column) per table ---
TABLE_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "raw_ais_positions": [("mmsi", "mmsi"), ("ship_name", "vessel_name"), ("msg_type", "ship_type"),
                          ("lat", "latitude"), ("lon", "longitude"), ("sog", "speed_knots"), ("cog", "course_deg"),
                          ("true_heading", "heading_deg"), ("nav_status", "nav_status"),
                          ("received_at", "timestamp")],
    "raw_comtrade_flows": [("reporter", "reporter_code"), ("partner", "partner_code"), ("hs_code", "cmd_code"),
                           ("trade_value", "primary_value"), ("weight", "net_wgt"), ("period", "period")],
    "raw_weather_observations": [("port_code", "port_code"), ("timestamp", "observation_hour"),
                                 ("wave_height_m", "wave_height_m"), ("wave_period_s", "wave_period_s"),
                                 ("wave_direction_deg", "wave_direction_deg")],
    "raw_gdelt_events": [("event_id", "event_id"), ("date", "event_date"), ("source_url", "source_url"),
                         ("event_code", "event_code"), ("lat", "lat"), ("lon", "lon")],
    "raw_fred_indicators": [("series_id", "series_id"), ("date", "observation_date"), ("value", "value")],
}

MACRO_SERIES = ["GSCPI", "DCOILWTICO", "DTWEXBGS"]
MAX_WAVE_M = 25.0
MAX_SPEED_KN = 50.0


def load_mapped(records: DataFrame, table: str, types: dict[str, str] | None = None) -> DataFrame:
    """Project source keys to warehouse columns; blank or null -> null; optional typed cast."""
    types = types or {}
    cols = []
    for src, dst in TABLE_COLUMNS[table]:
        c = F.nullif(F.col(src).cast("string"), F.lit("")) if src in records.columns else F.lit(None).cast("string")
        cols.append((c.try_cast(types[dst]) if dst in types else c).alias(dst))
    return records.select(*cols)


def minute_sample(records: DataFrame, minutes: int, time_text: str = "received_at") -> DataFrame:
    """Keep records whose arrival minute is < n; records without a usable time stay."""
    if minutes <= 0:
        return records
    t = F.col(time_text).cast("string")
    mm = F.substring(t, 15, 2)
    usable = (F.length(t) >= 16) & mm.rlike("^[0-9]{2}$")
    return records.filter(~usable | (mm.cast("int") < minutes))


# --- D1 ------------------------------------------------------------------------

def stage_positions(positions: DataFrame, ports: DataFrame, radius_nm: float = R.INBOUND_RADIUS_NM) -> DataFrame:
    """Typed, de-duplicated on (mmsi, received_at) (lowest event id kept), nearest port and zone.

    De-duplication is a grouped min_by (partial aggregation), not a window.
    Zone: at_berth / at_anchor / approaching / in_transit by the live-map cut-offs
    (2 nm, 5 nm below 1 kn; 30 nm); no port within the radius -> in_transit.
    """
    cols = ["event_id", "ship_name", "lat", "lon", "sog", "cog", "nav_status", "date"]
    dedup = (positions.groupBy("mmsi", "received_at")
             .agg(F.min_by(F.struct(*cols), F.col("event_id")).alias("_r")).select("mmsi", "received_at", "_r.*"))
    sites = ports.select("port_code", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon"))
    j = nearest_in_reach(dedup, sites, radius_nm)
    zone = (F.when(F.col("distance_nm").isNull(), "in_transit")
            .otherwise(F.element_at(F.create_map(F.lit("berth"), F.lit("at_berth"), F.lit("anchor"), F.lit("at_anchor"),
                                                 F.lit("approaching"), F.lit("approaching"), F.lit("transit"),
                                                 F.lit("in_transit")),
                                    live_zone(F.col("distance_nm"), F.coalesce(F.col("sog"), F.lit(0.0))))))
    return j.withColumn("zone", zone)


# --- D2, D9 ----------------------------------------------------------------------

def weather_severity(wave, wind_wave, swell) -> Column:
    """0.5 wave + 0.3 wind wave + 0.2 swell; a missing component counts 0."""
    z = F.lit(0.0)
    return (0.5 * F.coalesce(wave, z) + 0.3 * F.coalesce(wind_wave, z) + 0.2 * F.coalesce(swell, z))


def stage_weather(weather: DataFrame) -> DataFrame:
    """Numeric casts, drop waves over 25 m, hour in UTC, severity."""
    swell = F.col("swell_wave_height_m") if "swell_wave_height_m" in weather.columns else F.lit(None).cast("double")
    return (weather.select("port_code", F.col("obs_hour").cast("timestamp_ntz").alias("observation_hour"),
                           F.col("wave_height_m").try_cast("double").alias("wave_height_m"),
                           F.col("wind_wave_height_m").try_cast("double").alias("wind_wave_height_m"),
                           swell.alias("swell_wave_height_m"))
            .filter(F.col("wave_height_m").isNull() | (F.col("wave_height_m") <= MAX_WAVE_M))
            .withColumn("weather_severity", weather_severity(F.col("wave_height_m"), F.col("wind_wave_height_m"),
                                                             F.col("swell_wave_height_m"))))


# --- D3, D4 ------------------------------------------------------------------------

def stage_trade(trade: DataFrame, commodity_codes: list[str] | None = None) -> DataFrame:
    """Standard (trimmed upper-case) country names, optional commodity filter, money casts (D3)."""
    t = trade.select(F.upper(F.trim(F.col("reporter"))).alias("reporter_code"),
                     F.trim(F.col("cmd_code")).alias("cmd_code"),
                     F.col("period").cast("date").alias("period"),
                     F.col("primary_value").try_cast("double").alias("primary_value"))
    if commodity_codes is not None:
        t = t.filter(F.col("cmd_code").isin(commodity_codes))
    return t


def stage_macro(macro: DataFrame) -> DataFrame:
    """'.' -> null, date cast, only the three tracked series."""
    return (macro.filter(F.col("series_id").isin(MACRO_SERIES))
            .select("series_id", F.col("obs_date").cast("date").alias("observation_date"),
                    F.nullif(F.trim(F.col("value_text")), F.lit(".")).try_cast("double").alias("value")))


# --- D5, D6 ------------------------------------------------------------------------

def mart_port_daily(staged: DataFrame) -> DataFrame:
    """Daily vessels by zone and anchored share per port."""
    z = F.col("zone")
    # one row per vessel first: plain sums then, instead of four distinct counts that would copy every row
    kinds = {"vessels_at_berth": "at_berth", "vessels_at_anchor": "at_anchor", "vessels_approaching": "approaching"}
    vessels = (staged.filter(F.col("port_code").isNotNull())
               .groupBy("port_code", F.to_date("received_at").alias("activity_date"), "mmsi")
               .agg(*[F.max(z == kind).alias(name) for name, kind in kinds.items()]))
    g = vessels.groupBy("port_code", "activity_date").agg(F.count("mmsi").alias("total_vessels"),
                                                          *[F.count_if(F.col(name)).alias(name) for name in kinds])
    return g.withColumn("congestion_score", F.col("vessels_at_anchor") / F.col("total_vessels"))


def mart_vessel_daily(staged: DataFrame) -> DataFrame:
    """Per vessel and day: mean, max and spread of speed, distance travelled, hours at anchor vs transit.

    Consecutive messages are paired with ``lag`` inside (mmsi, day), so a
    window holds one vessel-day.  A gap counts as anchor time when the earlier
    message's speed is at most 0.5 kn, else as transit time.
    """
    day = F.to_date("received_at")
    s = staged.withColumn("activity_date", day)
    w = Window.partitionBy("mmsi", "activity_date").orderBy("received_at", "event_id")
    s = (s.withColumn("_plat", F.lag("lat").over(w)).withColumn("_plon", F.lag("lon").over(w))
         .withColumn("_pts", F.lag("received_at").over(w)).withColumn("_psog", F.lag("sog").over(w)))
    leg = F.when(F.col("_plat").isNotNull(), haversine_nm(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon")))
    gap_h = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("_pts").cast("timestamp"))) / 3.6e9
    slow = F.coalesce(F.col("_psog"), F.lit(0.0)) <= 0.5
    return (s.groupBy("mmsi", "activity_date")
            .agg(F.avg("sog").alias("avg_speed"), F.max("sog").alias("max_speed"),
                 F.stddev_samp("sog").alias("speed_stddev"),
                 F.coalesce(F.sum(leg), F.lit(0.0)).alias("distance_nm"),
                 F.coalesce(F.sum(F.when(F.col("_pts").isNotNull() & slow, gap_h)), F.lit(0.0)).alias("anchor_hours"),
                 F.coalesce(F.sum(F.when(F.col("_pts").isNotNull() & ~slow, gap_h)), F.lit(0.0)).alias("transit_hours"),
                 F.count("*").alias("messages")))


# --- D7 ------------------------------------------------------------------------------

def quality_checks(positions: DataFrame, port_daily: DataFrame, macro_staged: DataFrame, weather: DataFrame,
                   ports: DataFrame, attribution: DataFrame, trade_staged: DataFrame, as_of: Column) -> DataFrame:
    """Eight checks, one row each: (check_name, violations) (D7).  Every source is read once, by one aggregate."""
    lat, lon = F.col("lat"), F.col("lon")

    def checked(df: DataFrame, **violations: Column) -> DataFrame:
        one = df.agg(*[c.cast("bigint").alias(name) for name, c in violations.items()])
        pairs = [x for name in violations for x in (F.lit(name), F.col(name))]
        return one.select(F.stack(F.lit(len(violations)), *pairs).alias("check_name", "violations"))

    checks = [
        checked(positions, coordinates_in_range=F.count_if((lat < -90) | (lat > 90) | (lon < -180) | (lon > 180)),
                speed_below_50kn=F.count_if(F.col("sog") >= MAX_SPEED_KN), no_future_timestamps=F.count_if(F.col("received_at") > as_of)),
        checked(port_daily, congestion_score_in_unit_range=F.count_if((F.col("congestion_score") < 0) | (F.col("congestion_score") > 1))),
        checked(macro_staged.select("series_id").distinct(), macro_series_complete=F.lit(len(MACRO_SERIES)) - F.count("series_id")),
        checked(ports.join(weather.select("port_code").distinct(), "port_code", "left_anti"), weather_coverage_per_port=F.count(F.lit(1))),
        checked(attribution.groupBy("event_id").count().filter(F.col("count") > 1), no_duplicate_events=F.count(F.lit(1))),
        checked(trade_staged, positive_trade_values=F.count_if(F.col("primary_value") <= 0)),
    ]
    return reduce(DataFrame.unionByName, checks).withColumn("passed", F.col("violations") == 0)


# --- D8, D10 --------------------------------------------------------------------------

def point_in_time_features(labels: DataFrame, features: DataFrame, feature_cols: list[str],
                           label_time: str = "observation_hour", feature_time: str = "observation_hour") -> DataFrame:
    """Each label row with the latest feature row at or before its time, per port."""
    f = features.select("port_code", F.col(feature_time).alias("_ft"), *feature_cols)
    j = asof_join(labels, f, by=["port_code"], left_time=F.col(label_time), right_time="_ft",
                  payload=feature_cols, strict=False, bucket_seconds=86400)
    return j.select(*labels.columns, F.col("_asof.matched_time").alias("feature_time"),
                    *[F.col("_asof." + c).alias(c) for c in feature_cols])


def tide_stations(spark) -> DataFrame:
    return spark.createDataFrame(R.TIDE_STATIONS, "port_code string, station_id string")


def hours_to_high_tide(port_hours: DataFrame, tides: DataFrame, stations: DataFrame) -> DataFrame:
    """Hours from each port-hour to the next valid high tide; null without a station.

    Forward as-of join per port; ports without a station get null through the
    left join on the station table (N9).
    """
    highs = (tides.filter(F.col("tide_type") == "H").select("port_code", "tide_ts", "tide_level_m"))
    j = asof_join(port_hours, highs, by=["port_code"], left_time=F.col("observation_hour"), right_time="tide_ts",
                  payload=["tide_level_m"], strict=False, bucket_seconds=86400, direction="forward")
    nxt = F.col("_asof.matched_time")
    hours = (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("observation_hour").cast("timestamp"))) / 3.6e9
    st = F.broadcast(stations.select("port_code", "station_id").dropDuplicates(["port_code"]))
    return (j.join(st, "port_code", "left")
            .select(*port_hours.columns, "station_id",
                    F.when(F.col("station_id").isNotNull(), nxt).alias("next_high_tide"),
                    F.when(F.col("station_id").isNotNull(), hours).alias("hours_to_next_high_tide")))
