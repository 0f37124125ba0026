"""Per-port operations boards for all ports in one pass.

The source pipeline runs four SQL statements per port (40 remote queries, each
re-scanning the same partitions) and finishes in a Python row loop.  Here the
port filter is dropped, every step is partitioned or grouped by port, and the
per-vessel scoring is Column expressions.

Skew: a port is a hot key (10 values; one may hold a third of the vessels).
Nothing collects a port's rows into one task: aggregates are partial, lists are
ranked over ranges of their whole sort key, and full counts come from a
separate grouped count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.functions import rules
from tidewater.operators.ranking import range_rank
from tidewater.operators.spatial import distance_join
from tidewater.plans.features import as_of_column, lookback

RADIUS = R.SURFACED_VESSEL_RADIUS_NM


def _sites(ports: DataFrame) -> DataFrame:
    return ports.select("port_code", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon"))


def recent_positions(positions: DataFrame, as_of: Column, hours: int = 6, days: int = 2) -> DataFrame:
    """Messages of the last ``hours`` inside the last ``days`` partitions."""
    return lookback(positions, as_of, days, time_col="received_at").filter(
        F.col("received_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def current_positions(positions: DataFrame, as_of: Column) -> DataFrame:
    """Rows at each vessel's newest time, vessels seen within 6 h (F2, J8; ties kept).

    The newest row of a kept vessel is itself within the 6 h window, so both
    sides are cut to the window first.  The join back is on (mmsi, time): a hot
    vessel spreads over its timestamps.
    """
    recent = recent_positions(positions, as_of)
    latest = recent.groupBy("mmsi").agg(F.max("received_at").alias("received_at"))
    return recent.join(latest, ["mmsi", "received_at"], "inner")


def nearest_port_current(positions: DataFrame, ports: DataFrame, as_of: Column) -> DataFrame:
    """Current vessels with their nearest port, kept when within 50 nm (J3 + F1).

    The nearest port overall is within 50 nm exactly when the 50 nm grid join
    finds it, so no vessel x port product is formed.
    """
    cur = current_positions(positions, as_of)
    pairs = distance_join(cur, _sites(ports), RADIUS)
    cols = ["port_code", "ship_name", "lat", "lon", "sog", "nav_status", "distance_nm", "received_at"]
    tb = F.struct(F.col("distance_nm"), F.col("port_code"), *([F.col("event_id")] if "event_id" in pairs.columns else []))
    return (pairs.groupBy("mmsi").agg(F.min_by(F.struct(*cols), tb).alias("_b"))
            .select("mmsi", "_b.*"))


def latest_wave(weather: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Wave height at each port's newest forecast time (J13: the scalar subquery for all ports at once)."""
    w = lookback(weather, as_of, days)
    order = F.struct("obs_hour", *[c for c in ("fetched_at", "event_id") if c in w.columns])
    return w.groupBy("port_code").agg(F.max_by("wave_height_m", order).alias("max_wave_height_m"))


def port_summary(positions: DataFrame, weather: DataFrame, ports: DataFrame, *, as_of=None) -> DataFrame:
    """Vessels, anchored, mean speed of nearest-port vessels within 50 nm, latest wave.

    Starts from the port dimension so a port without vessels still gives a row
    (count 0, null sums), like the per-port global aggregate.
    """
    a = as_of_column(as_of, positions)
    near = nearest_port_current(positions, ports, a)
    nav = F.coalesce(F.col("nav_status"), F.lit(15))
    d = F.col("distance_nm")
    anchored = (F.when((nav == 5) & (d <= 15), 0)
                .when(((nav == 1) & (d <= 30)) | ((F.coalesce(F.col("sog"), F.lit(0.0)) <= 1) & (d <= 30)), 1)
                .otherwise(0))
    agg = near.groupBy("port_code").agg(F.count("*").alias("total_vessels"),
                                        F.sum(anchored).cast("bigint").alias("vessels_at_anchor"),
                                        F.avg(F.coalesce(F.col("sog"), F.lit(0.0))).alias("avg_speed_in_zone"))
    wave = latest_wave(weather, a)
    dim = ports.select("port_code")
    return (dim.join(agg, "port_code", "left").join(wave, "port_code", "left")
            .select("port_code", F.coalesce(F.col("total_vessels"), F.lit(0)).cast("bigint").alias("total_vessels"),
                    "vessels_at_anchor", "avg_speed_in_zone", "max_wave_height_m"))


def port_trend(positions: DataFrame, weather: DataFrame, ports: DataFrame, *, as_of=None,
               days: int = 6, keep: int = 6) -> DataFrame:
    """Six most recent days per port: vessels, anchored, mean speed, max wave."""
    a = as_of_column(as_of, positions)
    pos = lookback(positions, a, days, time_col="received_at")
    order = F.struct("received_at", "event_id") if "event_id" in pos.columns else F.col("received_at")
    daily = (pos.groupBy("date", "mmsi")
             .agg(F.max_by(F.struct("ship_name", "lat", "lon", "sog", "nav_status"), order).alias("_l"))
             .select("date", "mmsi", "_l.*"))
    pairs = distance_join(daily, _sites(ports), RADIUS)
    near = (pairs.groupBy("date", "mmsi")
            .agg(F.min_by(F.struct("port_code", "sog", "nav_status", "distance_nm"),
                          F.struct("distance_nm", "port_code")).alias("_b"))
            .select("date", "mmsi", "_b.*"))
    nav = F.coalesce(F.col("nav_status"), F.lit(15))
    anchored = F.when(nav == 5, 0).when((nav == 1) | (F.coalesce(F.col("sog"), F.lit(0.0)) <= 1), 1).otherwise(0)
    agg = near.groupBy("port_code", "date").agg(
        F.count("*").alias("total_vessels"), F.sum(anchored).cast("bigint").alias("vessels_at_anchor"),
        F.avg(F.coalesce(F.col("sog"), F.lit(0.0))).alias("avg_speed_in_zone"))
    wd = (lookback(weather, a, days).groupBy("port_code", "date")
          .agg(F.max("wave_height_m").alias("max_wave_height_m")))
    j = agg.join(wd, ["port_code", "date"], "left")
    w = Window.partitionBy("port_code").orderBy(F.col("date").desc())
    return (j.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
            .select("port_code", F.col("date").alias("activity_date"), "total_vessels", "vessels_at_anchor",
                    "avg_speed_in_zone", F.coalesce(F.col("max_wave_height_m"), F.lit(0.0)).alias("max_wave_height_m")))


def trend_scores(trend: DataFrame, ports: DataFrame, size: int = 6) -> DataFrame:
    """Latest six daily scores oldest first, left-padded with the first value or zeros."""
    score = rules.congestion_score(F.coalesce("total_vessels", F.lit(0)), F.coalesce("vessels_at_anchor", F.lit(0)),
                                   F.coalesce("avg_speed_in_zone", F.lit(0.0)),
                                   F.coalesce("max_wave_height_m", F.lit(0.0)))
    lists = (trend.groupBy("port_code")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("activity_date").alias("d"), score.alias("s"))))
                  .alias("_l")))
    vals = F.transform(F.coalesce(F.col("_l"), F.array().cast("array<struct<d:string,s:double>>")), lambda x: x["s"])
    n = F.size(vals)
    last = F.when(n >= size, F.slice(vals, -size, size)).otherwise(vals)
    padded = (F.when(n == 0, F.array_repeat(F.lit(0.0), size))
              .otherwise(F.concat(F.array_repeat(F.element_at(vals, 1), F.greatest(F.lit(size) - n, F.lit(0))), last)))
    return (ports.select("port_code").join(lists, "port_code", "left")
            .select("port_code", padded.alias("trend"), F.slice(padded, -5, 5).alias("forecast")))


def board_vessels(positions: DataFrame, ports: DataFrame, *, as_of=None) -> DataFrame:
    """All listed vessels with priority, display values and rule columns."""
    a = as_of_column(as_of, positions)
    near = nearest_port_current(positions, ports, a)
    dist = rules.py_round(F.col("distance_nm"), 1)
    speed = rules.py_round(F.coalesce(F.col("sog"), F.lit(0.0)), 1)
    v = (near.withColumn("zone_priority", rules.priority_class(F.col("distance_nm"), F.col("sog"), F.col("nav_status")))
         .withColumn("dist", dist).withColumn("speed", speed)
         .withColumn("zone", rules.display_zone(F.col("dist"), F.col("speed"), F.col("nav_status"))))
    return (v.withColumn("eta", rules.eta_text(F.col("dist"), F.col("speed"), F.col("zone")))
            .withColumn("conf", rules.confidence(F.col("dist"), F.col("speed"), F.col("zone")))
            .withColumn("name", rules.name_fallback(F.col("ship_name"), F.col("mmsi"))))


def ranked(df: DataFrame, order: list, rank: str, limit: int | None) -> DataFrame:
    """Rank within each port by ``order``.

    All rows: ranges of the whole sort key, so that no port's rows are sorted in one task.  ``limit``, an explicit top-k: a
    filtered row number, of which every task keeps the first ``limit`` rows of a port before the shuffle.
    """
    if limit is None:
        return range_rank(df, ["port_code"], order, rank).withColumn(rank, F.col(rank).cast("int"))
    top = Window.partitionBy("port_code").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(top).cast("int")).filter(F.col(rank) <= limit)


def vessel_list(vessels: DataFrame, limit: int | None = None) -> DataFrame:
    """All vessels by priority, distance, speed desc, with the port's count (T3); ``limit`` asks for a top-k."""
    order = ["zone_priority", "distance_nm", F.coalesce(F.col("sog"), F.lit(0.0)).desc(), "mmsi"]
    top = ranked(vessels, order, "list_rank", limit)
    totals = vessels.groupBy("port_code").agg(F.count("*").alias("vessels_total"))
    return top.join(totals, "port_code", "left")


def arrival_schedule(vessels: DataFrame, limit: int | None = None) -> DataFrame:
    """Approaching and transit vessels, nearest first (T4); ``limit`` asks for a top-k."""
    order = ["dist", "zone_priority", "distance_nm", F.coalesce(F.col("sog"), F.lit(0.0)).desc(), "mmsi"]
    moving = vessels.filter(F.col("zone").isin("approaching", "transit"))
    return (ranked(moving, order, "schedule_rank", limit)
            .select("port_code", "schedule_rank", F.col("name").alias("vessel"), F.col("mmsi").cast("string").alias("mmsi"),
                    F.lit("Arrival").alias("type"), F.lit("In Transit").alias("status"), "eta",
                    F.col("dist").alias("distance_nm")))


def board_metrics(vessels: DataFrame, summary: DataFrame, ports: DataFrame) -> DataFrame:
    """Tracked, waiting, berthed, mean speed (1 decimal), max wave, congestion percent."""
    agg = vessels.groupBy("port_code").agg(
        F.count("*").alias("tracked"), F.count_if(F.col("zone") == "anchor").alias("waiting"),
        F.count_if(F.col("zone") == "berth").alias("berthed"), F.sum("speed").alias("_speed_sum"))
    j = (ports.select("port_code").join(agg, "port_code", "left")
         .join(summary.select("port_code", "max_wave_height_m"), "port_code", "left"))
    tracked = F.coalesce(F.col("tracked"), F.lit(0))
    avg_speed = F.when(tracked > 0, rules.py_round(F.col("_speed_sum") / tracked, 1)).otherwise(F.lit(0.0))
    wave = rules.py_round(F.coalesce(F.col("max_wave_height_m"), F.lit(0.0)), 1)
    j = j.select("port_code", tracked.alias("tracked"), F.coalesce("waiting", F.lit(0)).alias("waiting"),
                 F.coalesce("berthed", F.lit(0)).alias("berthed"), avg_speed.alias("avg_speed"), wave.alias("max_wave"))
    score = rules.congestion_score(F.col("tracked"), F.col("waiting"), F.col("avg_speed"), F.col("max_wave"))
    return j.withColumn("congestion_pct", rules.py_round(score * 100, 0).cast("int"))


def coverage_diagnostics(positions: DataFrame, ports: DataFrame, *, as_of=None) -> DataFrame:
    """Message counts and times within 50 / 200 nm over the last 6 h, no vessel dedup."""
    a = as_of_column(as_of, positions)
    recent = recent_positions(positions, a).select("lat", "lon", F.col("received_at").alias("observed_at"))
    pairs = distance_join(recent, _sites(ports), R.DIAGNOSTIC_RADIUS_NM)
    d = F.col("distance_nm")
    agg = pairs.groupBy("port_code").agg(
        F.count_if(d <= RADIUS).alias("messages_within_50nm"),
        F.count("*").alias("messages_within_200nm"),
        F.max(F.when(d <= RADIUS, F.col("observed_at"))).alias("latest_within_50nm"),
        F.max("observed_at").alias("latest_within_200nm"),
        F.min("distance_nm").alias("nearest_distance_nm"))
    j = ports.select("port_code").join(agg, "port_code", "left")
    m50 = F.coalesce(F.col("messages_within_50nm"), F.lit(0))
    m200 = F.coalesce(F.col("messages_within_200nm"), F.lit(0))
    j = j.select("port_code", m50.alias("messages_within_50nm"), m200.alias("messages_within_200nm"),
                 "latest_within_50nm", "latest_within_200nm",
                 rules.py_round(F.col("nearest_distance_nm"), 1).alias("nearest_distance_nm"))
    status = rules.coverage_status(F.col("port_code"), F.col("messages_within_50nm"), F.col("messages_within_200nm"))
    j = j.withColumn("status", status)
    return (j.withColumn("message", rules.coverage_field(F.col("port_code"), F.col("status"), 0))
            .withColumn("detail", rules.coverage_field(F.col("port_code"), F.col("status"), 1))
            .withColumn("second_source_validation", rules.coverage_field(F.col("port_code"), F.col("status"), 2)))


def berth_occupancy(metrics: DataFrame) -> DataFrame:
    """Terminal i of a port is occupied when i < berthed count (X18); ports without terminals give no rows."""
    rows = [(code, i + 1, name) for code, names in R.PORT_TERMINALS.items() for i, name in enumerate(names)]
    spark = metrics.sparkSession
    terms = spark.createDataFrame(rows, "port_code string, berth_no int, name string")
    j = F.broadcast(terms).join(metrics.select("port_code", "berthed"), "port_code", "inner")
    return j.select("port_code", F.format_string("berth-%d", F.col("berth_no")).alias("berth_id"), "name",
                    F.when(F.col("berth_no") - 1 < F.col("berthed"), "occupied").otherwise("available").alias("status"))


def zone_mix(vessels: DataFrame) -> DataFrame:
    """Count and share per (port, zone) (A20): share by a per-port total from a grouped count."""
    c = vessels.groupBy("port_code", "zone").agg(F.count("*").alias("vessels"))
    tot = c.groupBy("port_code").agg(F.sum("vessels").alias("_t"))
    return (c.join(F.broadcast(tot), "port_code")
            .select("port_code", "zone", "vessels", (F.col("vessels") / F.col("_t")).alias("share")))


BUCKETS = ["0-10 nm", "10-50 nm", "50-100 nm", "100-150 nm", "150-200 nm"]


def distance_buckets(vessels: DataFrame, ports: DataFrame) -> DataFrame:
    """Vessel counts in all five distance buckets of every port, upper bounds inclusive."""
    counts = (vessels.groupBy("port_code", rules.distance_bucket(F.col("dist")).alias("bucket"))
              .agg(F.count("*").alias("vessels")))
    every = ports.select("port_code", F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    return (every.join(counts, ["port_code", "bucket"], "left")
            .select("port_code", "bucket", F.coalesce("vessels", F.lit(0)).cast("bigint").alias("vessels")))


def port_ranking(metrics: DataFrame, ports: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Ports by congestion, waiting, tracked (desc), then name (T7) with risk and pressure labels.

    A coverage issue is a diagnostics status of limited coverage or of no messages.
    """
    coverage_issue = F.col("status").isin("coverage_limited", "no_provider_messages")
    j = metrics.join(ports.select("port_code", "port_name"), "port_code") \
        .join(diagnostics.select("port_code", "status"), "port_code")
    w = Window.orderBy(F.col("congestion_pct").desc(), F.col("waiting").desc(), F.col("tracked").desc(), "port_name")
    # one row per port: a global order over the (bounded) port dimension
    return (j.withColumn("rank", F.row_number().over(w).cast("int"))
            .withColumn("risk", rules.risk_tier(F.col("congestion_pct")))
            .withColumn("pressure", rules.pressure_label(coverage_issue, F.lit(True), F.col("waiting"),
                                                         F.col("congestion_pct"), F.col("tracked")))
            .withColumn("anchor_severity", rules.anchor_severity(F.col("waiting")))
            .withColumn("berthed_share", F.when((F.col("tracked") > 0) & ~coverage_issue,
                                                F.round(F.col("berthed") / F.col("tracked") * 100, 0).cast("int"))
                        .otherwise(F.lit(0)))
            .withColumn("wave_pct", F.least(F.col("max_wave") / 5 * 100, F.lit(100.0))).drop("status"))


def day_labels(as_of: Column, spark) -> DataFrame:
    """'Today', 'Yesterday', else 'd Mon' for the 6 trend days and 5 outlook days, oldest first."""
    today = F.to_date(as_of)
    rows = spark.createDataFrame([("trend", 6), ("outlook", 5)], "kind string, days int")
    d = rows.select("kind", F.posexplode(F.sequence(F.col("days") - 1, F.lit(0), F.lit(-1))).alias("position", "ago"))
    day = F.date_sub(today, F.col("ago"))
    label = F.when(F.col("ago") == 0, "Today").when(F.col("ago") == 1, "Yesterday").otherwise(F.date_format(day, "d MMM"))
    return d.select("kind", "position", label.alias("label"))
