"""Curated feature and label tables, one DataFrame function per table.

Order of the graph: hourly positions -> inbound rings (v1) and vessel states
(v2); news -> attribution -> event signals; status v1/v2 join weather and
events; the label reads the inbound table.  Every step aggregates to the
(vessel, hour) or (port, hour) grain before any window, so per-key windows
hold at most one row per hour of the lookback.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.functions import rules
from tidewater.functions.timefn import date_text, hour_of_day, hour_trunc, iso_day_of_week
from tidewater.operators.spatial import distance_join
from tidewater.operators.temporal import asof_join, hourly_range_sums

AsOf = Column | str | _dt.datetime | None


def ports_frame(spark: SparkSession) -> DataFrame:
    """The fixed ten-port dimension."""
    rows = [(c, n, f, float(la), float(lo), i) for i, (c, n, f, la, lo) in enumerate(R.PORTS)]
    return spark.createDataFrame(rows, "port_code string, port_name string, flag string, "
                                       "lat double, lon double, port_idx int")


def _port_sites(ports: DataFrame) -> DataFrame:
    return ports.select("port_code", "port_name", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon"))


def as_of_column(as_of: AsOf, source: DataFrame | None = None, time_col: str = "received_at") -> Column:
    """The run's reference time as a literal: the given one, else the newest ``time_col`` (one pass over that column).

    A literal, so that lookbacks prune partitions and row groups when the plan is made.
    """
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        if source is None:
            raise ValueError("as_of or a source frame is required")
        as_of = source.agg(F.max(time_col).cast("timestamp_ntz")).first()[0]
    return F.lit(as_of).cast("timestamp_ntz")


def lookback(df: DataFrame, as_of: Column, days: int, date_col: str = "date", time_col: str | None = None) -> DataFrame:
    """Keep partitions with date >= as_of date - days.

    ``time_col``: the column whose day is the date; the same bound on it reaches row groups where the date is computed.
    """
    day = F.date_sub(F.to_date(as_of), days)
    kept = df.filter(F.col(date_col) >= F.date_format(day, "yyyy-MM-dd"))
    return kept if time_col is None else kept.filter(F.col(time_col) >= day.cast("timestamp_ntz"))


# ---------------------------------------------------------------------------
# A1 hourly last position
# ---------------------------------------------------------------------------

def hourly_positions(positions: DataFrame, *, extended: bool = False, as_of: AsOf = None,
                     lookback_days: int | None = 90) -> DataFrame:
    """Last known values per (mmsi, hour) with one max_by(struct) (A1).

    Ties on received_at are broken by event_id when the column exists.
    """
    pos = positions
    if lookback_days is not None:
        pos = lookback(pos, as_of_column(as_of, positions), lookback_days, time_col="received_at")
    cols = ["lat", "lon", "sog"] + (["ship_name", "cog", "true_heading", "nav_status"] if extended else [])
    order = F.struct("received_at", "event_id") if "event_id" in pos.columns else F.col("received_at")
    return (pos.groupBy("mmsi", hour_trunc("received_at").alias("observation_hour"))
            .agg(F.max_by(F.struct(*cols), order).alias("_l"), F.max("date").alias("date_partition"))
            .select("mmsi", "observation_hour", "_l.*", "date_partition"))


# ---------------------------------------------------------------------------
# feature_vessel_inbound_hourly (A3-A5 over J2)
# ---------------------------------------------------------------------------

def vessel_inbound_hourly(positions: DataFrame, ports: DataFrame, *, as_of: AsOf = None,
                          radius_nm: float = R.INBOUND_RADIUS_NM, hourly: DataFrame | None = None) -> DataFrame:
    hp = hourly if hourly is not None else hourly_positions(positions, as_of=as_of)
    pairs = distance_join(hp, _port_sites(ports), radius_nm)
    d = F.col("distance_nm")
    return (pairs.groupBy("port_code", "observation_hour", "date_partition")
            .agg(F.count_if(d <= 10).alias("vessels_in_10nm"),
                 F.count_if(d <= 50).alias("vessels_in_50nm"),
                 F.count_if(d <= 200).alias("vessels_in_200nm"),
                 F.count_if((d <= 10) & (F.col("sog") < 2)).alias("vessels_at_anchor"),
                 F.avg(F.when(d <= 50, F.col("sog"))).alias("avg_speed_50nm"))
            .select("port_code", "observation_hour", "vessels_in_10nm", "vessels_in_50nm", "vessels_in_200nm",
                    "vessels_at_anchor", "avg_speed_50nm", "date_partition"))


# ---------------------------------------------------------------------------
# feature_vessel_state_hourly
# ---------------------------------------------------------------------------

def hourly_with_voyage(positions: DataFrame, voyage: DataFrame, *, as_of: AsOf = None,
                       lookback_days: int = 90, hourly: DataFrame | None = None) -> DataFrame:
    """Hourly positions with the latest voyage message received before hour + 1 h.

    The as-of match depends only on (mmsi, hour), so it runs before the port
    join, once per vessel-hour instead of once per vessel-hour-port.
    """
    a = as_of_column(as_of, positions)
    hp = hourly if hourly is not None else hourly_positions(positions, extended=True, as_of=a, lookback_days=lookback_days)
    vy = lookback(voyage, a, lookback_days, time_col="received_at")
    tb = "event_id" if "event_id" in vy.columns else None
    joined = asof_join(hp, vy, by=["mmsi"], left_time=F.col("observation_hour") + F.expr("INTERVAL 1 HOUR"),
                       right_time="received_at", payload=["destination", "eta_ts", "draught_m", "ship_type"],
                       strict=True, bucket_seconds=3600, left_time_at_bucket_end=True, left_row_per_bucket=True, tiebreak=tb)
    return joined.select("*", F.col("_asof.destination").alias("destination"),
                         F.col("_asof.eta_ts").alias("eta_timestamp_utc"),
                         F.col("_asof.draught_m").alias("draught_m"),
                         F.col("_asof.ship_type").alias("ship_type")).drop("_asof")


def vessel_state_hourly(positions: DataFrame, voyage: DataFrame, ports: DataFrame, *, as_of: AsOf = None,
                        radius_nm: float = R.INBOUND_RADIUS_NM, hourly: DataFrame | None = None) -> DataFrame:
    hv = hourly_with_voyage(positions, voyage, as_of=as_of, hourly=hourly)
    pairs = distance_join(hv, _port_sites(ports), radius_nm)
    from pyspark.sql import Window
    # the as-of join left the rows dealt by vessel, and so they stay here
    w = Window.partitionBy("port_code", "mmsi").orderBy("observation_hour")
    t = pairs.withColumn("distance_delta_nm", F.col("distance_nm") - F.lag("distance_nm").over(w))
    t = (t.withColumn("destination_matches_port",
                      rules.destination_matches(F.col("destination"), F.col("port_code"), F.col("port_name")))
         .withColumn("eta_within_48h", rules.eta_within(F.col("eta_timestamp_utc"), F.col("observation_hour"), 48)))
    t = t.withColumn("vessel_state", rules.vessel_state(F.col("distance_nm"), F.col("sog"), F.col("nav_status"),
                                                        F.col("distance_delta_nm"),
                                                        F.col("destination_matches_port"), F.col("eta_within_48h")))
    return t.select("port_code", "observation_hour", "mmsi", "ship_name", "lat", "lon", "sog", "cog",
                    "true_heading", "nav_status", "distance_nm", "distance_delta_nm", "destination",
                    "eta_timestamp_utc", "draught_m", "ship_type", "destination_matches_port", "eta_within_48h",
                    "vessel_state", "date_partition")


# ---------------------------------------------------------------------------
# weather (A9)
# ---------------------------------------------------------------------------

def weather_hourly(weather: DataFrame, *, as_of: AsOf = None, lookback_days: int = 90,
                   time_col: str = "obs_hour") -> DataFrame:
    """Mean wave and wind-wave height per (port, hour) over all forecast versions.

    ``avg_wind_kn`` is the mean wind-WAVE height in metres (name kept).
    """
    w = weather
    if lookback_days is not None and as_of is not None:
        w = lookback(w, as_of_column(as_of), lookback_days)
    return (w.groupBy("port_code", hour_trunc(time_col).alias("observation_hour"))
            .agg(F.avg("wave_height_m").alias("avg_wave_height"),
                 F.avg("wind_wave_height_m").alias("avg_wind_kn"),
                 F.max("date").alias("date_partition")))


# ---------------------------------------------------------------------------
# events: attribution (A17) and rolling signals
# ---------------------------------------------------------------------------

ATTRIBUTION_COLUMNS = ["event_id", "port_code", "port_name", "event_hour", "seen_at", "fetched_at", "source",
                       "query_name", "event_category", "severity_score", "attribution_reason", "title", "url",
                       "domain", "language", "source_country", "date_partition"]


def event_port_attribution_hourly(news_records: DataFrame) -> DataFrame:
    """Distinct attributed event rows with their event hour."""
    from tidewater.functions.timefn import parse_iso
    t = F.coalesce(F.col("seen_at"), F.col("fetched_at"))
    hour = hour_trunc(parse_iso(t))
    return (news_records
            .filter(F.col("port_code").isNotNull() & (F.trim(F.col("port_code")) != "") & t.isNotNull())
            .withColumn("event_hour", hour)
            .withColumn("date_partition", date_text(F.col("event_hour")))
            .select(*ATTRIBUTION_COLUMNS)
            .distinct())


def event_signals_hourly(attribution: DataFrame) -> DataFrame:
    """6 h / 24 h event pressure per (port, hour with events) (J6 as RANGE windows, A11).

    Rows are first summed per (port, event hour): a port's window partition
    then holds at most one row per hour, whatever the article volume.
    """
    sev = F.col("severity_score")
    cat = F.col("event_category")
    hourly = (attribution.filter(F.col("event_hour").isNotNull())
              .groupBy("port_code", F.col("event_hour").alias("observation_hour"))
              .agg(F.count("*").alias("n"),
                   F.count_if(sev >= R.SEVERE_EVENT_THRESHOLD).alias("n_severe"),
                   F.sum(sev).alias("sev_sum"),
                   F.count(sev).alias("sev_n"),
                   F.count_if(cat == "labor").alias("n_labor"),
                   F.count_if(cat == "conflict_security").alias("n_conflict"),
                   F.count_if(cat == "trade_policy").alias("n_policy"),
                   F.count_if(cat == "infrastructure").alias("n_infra")))
    sums = {
        "event_count_6h": ("n", 6), "event_count_24h": ("n", 24), "severe_event_count_24h": ("n_severe", 24),
        "_sev_sum": ("sev_sum", 24), "_sev_n": ("sev_n", 24), "labor_event_count_24h": ("n_labor", 24),
        "conflict_event_count_24h": ("n_conflict", 24), "policy_event_count_24h": ("n_policy", 24),
        "infrastructure_event_count_24h": ("n_infra", 24),
    }
    r = hourly_range_sums(hourly, partition=["port_code"], hour_col="observation_hour", sums=sums)
    return r.select(
        "port_code", "observation_hour", "event_count_6h", "event_count_24h", "severe_event_count_24h",
        F.coalesce(F.try_divide(F.col("_sev_sum"), F.col("_sev_n")), F.lit(0.0)).alias("avg_event_severity_24h"),
        "labor_event_count_24h", "conflict_event_count_24h", "policy_event_count_24h",
        "infrastructure_event_count_24h",
        # the newest event hour inside (T - 24 h, T] is T itself: every anchor hour has events
        F.col("observation_hour").alias("last_event_seen_at"),
        date_text(F.col("observation_hour")).alias("date_partition"))


EVENT_FEATURES = ["event_count_6h", "event_count_24h", "severe_event_count_24h", "avg_event_severity_24h",
                  "labor_event_count_24h", "conflict_event_count_24h", "policy_event_count_24h",
                  "infrastructure_event_count_24h"]


# ---------------------------------------------------------------------------
# feature_port_status_hourly (J4, J5, X5) and v2
# ---------------------------------------------------------------------------

def _join_context(base: DataFrame, weather_h: DataFrame, events_h: DataFrame) -> DataFrame:
    """Left-join weather and event signals on (port, hour); missing values become 0."""
    w = weather_h.select("port_code", "observation_hour", "avg_wave_height", "avg_wind_kn")
    e = events_h.select("port_code", "observation_hour", *EVENT_FEATURES)
    j = base.join(w, ["port_code", "observation_hour"], "left").join(e, ["port_code", "observation_hour"], "left")
    return j


def _context_cols() -> list[Column]:
    return ([F.coalesce(F.col("avg_wave_height"), F.lit(0.0)).alias("avg_wave_height_m"),
             F.coalesce(F.col("avg_wind_kn"), F.lit(0.0)).alias("avg_wind_kn")]
            + [F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in
               zip(EVENT_FEATURES, ["bigint", "bigint", "bigint", "double", "bigint", "bigint", "bigint", "bigint"])]
            + [hour_of_day("observation_hour").alias("hour_of_day"),
               iso_day_of_week("observation_hour").alias("day_of_week")])


def port_status_hourly(inbound: DataFrame, weather_h: DataFrame, events_h: DataFrame) -> DataFrame:
    j = _join_context(inbound, weather_h, events_h)
    return j.select("port_code", "observation_hour", "vessels_at_anchor", "vessels_in_10nm", "vessels_in_50nm",
                    "vessels_in_200nm", "avg_speed_50nm", *_context_cols(), "date_partition")


def port_status_hourly_v2(state: DataFrame, weather_h: DataFrame, events_h: DataFrame) -> DataFrame:
    """Aggregate vessel states per (port, hour, date) first, then join (A18): one row per key."""
    d = F.col("distance_nm")
    st = F.col("vessel_state")
    agg = (state.groupBy("port_code", "observation_hour", "date_partition")
           .agg(F.count_if(d <= 10).alias("vessels_in_10nm"),
                F.count_if(d <= 50).alias("vessels_in_50nm"),
                F.count_if(d <= 200).alias("vessels_in_200nm"),
                F.count_if(st == "waiting_anchor").alias("vessels_at_anchor"),
                F.count_if(st == "at_berth").alias("vessels_at_berth"),
                F.count_if(st == "waiting_anchor").alias("vessels_waiting_anchor"),
                F.count_if(st == "inbound").alias("vessels_inbound"),
                F.count_if(st == "outbound").alias("vessels_outbound"),
                F.count_if(st == "transit_unknown").alias("vessels_transit_unknown"),
                F.count_if(F.col("destination_matches_port") & F.col("eta_within_48h"))
                .alias("destination_match_48h_count"),
                F.avg(F.when(d <= 50, F.col("sog"))).alias("avg_speed_50nm"),
                F.avg("distance_delta_nm").alias("avg_distance_delta_nm"),
                F.avg(F.when(st == "waiting_anchor", F.col("draught_m"))).alias("avg_draught_waiting_anchor")))
    j = _join_context(agg, weather_h, events_h)
    return j.select("port_code", "observation_hour", "vessels_in_10nm", "vessels_in_50nm", "vessels_in_200nm",
                    "vessels_at_anchor", "vessels_at_berth", "vessels_waiting_anchor", "vessels_inbound",
                    "vessels_outbound", "vessels_transit_unknown", "destination_match_48h_count", "avg_speed_50nm",
                    "avg_distance_delta_nm", "avg_draught_waiting_anchor", *_context_cols(), "date_partition")


# ---------------------------------------------------------------------------
# congestion_target
# ---------------------------------------------------------------------------

def p75_by_port(inbound: DataFrame, as_of: Column, *, days: int = 90, accuracy: int = 10000) -> DataFrame:
    """75th percentile of the anchored count per port over the last ``days``.

    ``percentile_approx`` is a mergeable sketch (partial aggregation, bounded memory).
    """
    recent = inbound.filter(F.col("observation_hour") >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("port_code").agg(
        F.percentile_approx("vessels_at_anchor", 0.75, accuracy).alias("p75_anchor"))


def congestion_target(inbound: DataFrame, *, as_of: AsOf = None, source: DataFrame | None = None,
                      threshold: str = "global", least_anchor: int = 2, fan_out: bool = False) -> DataFrame:
    """Row for hour T carries the state at T + 24 h and a 0/1 label.

    The reference joins the table to itself on (port, hour).  Where an hour lies in one date partition that changes nothing,
    and the 24 h shift is a projection.  Where it lies in several, every one of its rows meets every other;
    ``fan_out`` does the same (a join of the rows with the counts of their hour).
    ``least_anchor``: a congested port holds more anchored vessels than that (2 in the reference).
    ``threshold='global'``: one p75 per port over the last 90 days at build
    time (reference behaviour); ``'trailing'``: p75 of the preceding 90 days
    of each row (no look-ahead), computed as a RANGE window per port over
    hourly rows.
    """
    a = as_of_column(as_of, source)
    if threshold == "global":
        p75 = F.broadcast(p75_by_port(inbound, a))  # one row per port: bounded by the port dimension
        base = inbound.join(p75, "port_code", "inner")
    else:
        from pyspark.sql import Window
        from tidewater.functions.timefn import epoch_seconds
        w = (Window.partitionBy("port_code").orderBy(epoch_seconds("observation_hour"))
             .rangeBetween(-90 * 86400, 0))
        base = inbound.withColumn("p75_anchor", F.percentile_approx("vessels_at_anchor", 0.75, 10000).over(w))
    if fan_out:
        key = ["port_code", "observation_hour"]
        later = base.select(*key, F.col("vessels_at_anchor").alias("_later"), F.col("p75_anchor"))
        base = base.select(*key, "date_partition").join(later, key).withColumn("vessels_at_anchor", F.col("_later"))
    fut = F.col("vessels_at_anchor")
    label = F.when((fut > F.col("p75_anchor")) & (fut > least_anchor), 1).otherwise(0)
    return base.select("port_code",
                       (F.col("observation_hour") - F.expr("INTERVAL 24 HOURS")).alias("observation_hour"),
                       fut.alias("future_anchor"), "p75_anchor", label.alias("is_congested_24h"),
                       "date_partition")
