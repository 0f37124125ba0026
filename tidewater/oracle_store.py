"""Oracle SQL (DuckDB) of the queries in ``queries_store``: what must come back of what was written."""

from __future__ import annotations

from tidewater import refdata as R

ISO = "'%Y-%m-%dT%H:%M:%SZ'"
POSITION = ("mmsi, ship_name AS vessel_name, msg_type AS ship_type, lat AS latitude, lon AS longitude, sog AS speed_knots, "
            "cog AS course_deg, CAST(true_heading AS DOUBLE) AS heading_deg, CAST(nav_status AS VARCHAR) AS nav_status, "
            "date_trunc('second', received_at) AS timestamp")


def store_oracles(with_views, news: str, voyage_sql: str) -> dict[str, str]:
    o: dict[str, str] = {}
    o["scan_raw_voyage"] = f"SELECT *, received_at[1:10] AS date FROM ({voyage_sql})"
    o["scan_raw_weather"] = with_views(["weather"], f"""SELECT port_code, strftime(obs_hour, {ISO}) AS timestamp, wave_height_m,
  CAST(event_id % 360 AS DOUBLE) AS wave_direction_deg, event_id % 20 / 2 AS wave_period_s, wind_wave_height_m,
  CAST(NULL AS DOUBLE) AS swell_wave_height_m, date FROM weather""")
    stations = ", ".join(f"('{p}', '{s}')" for p, s in R.TIDE_STATIONS)
    o["scan_raw_tides"] = with_views(["tides"], f"""SELECT port_code, station_id, strftime(tide_ts, {ISO}) AS timestamp,
  tide_level_m, tide_type, strftime(tide_ts, '%Y-%m-%d') AS date
FROM tides JOIN (VALUES {stations}) AS s(port_code, station_id) USING (port_code)""")
    columns = ("event_id, source, query_name, query, fetched_at, seen_at, title, url, domain, language, source_country, port_code, "
               "port_name, attribution_reason, event_category, severity_score, matched_terms")
    o["scan_raw_news"] = with_views(["news"], f"SELECT {columns}, fetched_at[1:10] AS date FROM records", news)
    o["ingest_counts"] = with_views(["news"], """SELECT run, count(*) AS records, count(nullif(port_code, '')) AS attributed,
  true AS wrote_files
FROM records JOIN (VALUES ('all'), ('labor')) AS r(run) ON run = 'all' OR query_name = run GROUP BY run""", news)
    rows = "FROM positions WHERE event_id % 50 NOT IN (7, 8)"
    o["load_incremental"] = with_views(["positions"], f"SELECT {POSITION}, CAST(1 + event_id % 2 AS BIGINT) AS load {rows}")
    o["load_incremental_weather"] = with_views(["weather"], """SELECT port_code, CAST(obs_hour AS TIMESTAMP) AS observation_hour,
  wave_height_m, event_id % 20 / 2 AS wave_period_s, CAST(event_id % 360 AS DOUBLE) AS wave_direction_deg,
  CAST(1 + event_id % 2 AS BIGINT) AS load
FROM weather WHERE event_id % 50 NOT IN (7, 8)""")
    o["load_manifest"] = with_views(["positions"], """SELECT CAST(1 + event_id % 2 AS BIGINT) AS load,
  chr(CAST(97 + event_id % 2 AS INTEGER)) AS "drop", count(*) FILTER (event_id % 50 NOT IN (7, 8)) AS rows,
  count(*) FILTER (event_id % 50 IN (7, 8)) AS rejected
FROM positions GROUP BY ALL""")
    o["load_rejects"] = with_views(["positions"], """SELECT CAST(1 + event_id % 2 AS BIGINT) AS load,
  CASE event_id % 50 WHEN 7 THEN 'no json object' ELSE 'no mmsi' END AS reason,
  CASE event_id % 50 WHEN 7 THEN '{"mmsi":' ELSE '{"ship_n' END AS head, count(*) AS lines
FROM positions WHERE event_id % 50 IN (7, 8) GROUP BY ALL""")
    o["load_full_reload"] = with_views(["positions"], f"SELECT {POSITION} {rows} AND minute(received_at) < 7")
    o["load_mapped_news"] = with_views(["news"], """SELECT event_id, CAST(fetched_at[1:10] AS DATE) AS event_date, url AS source_url,
  CAST(NULL AS VARCHAR) AS event_code, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon FROM records""", news)
    o["load_mapped_trade"] = with_views(["trade"], """SELECT reporter AS reporter_code, CAST(NULL AS VARCHAR) AS partner_code, cmd_code,
  primary_value, CAST(NULL AS DOUBLE) AS net_wgt, strftime(period, '%Y%m') AS period FROM trade""")
    o["load_mapped_macro"] = with_views(["macro"], """SELECT series_id, obs_date AS observation_date,
  TRY_CAST(value_text AS DOUBLE) AS value FROM macro""")
    o["list_sources"] = with_views(["weather", "tides"], """SELECT DISTINCT 'weather' AS source, date FROM weather
UNION SELECT DISTINCT 'noaa_tides', strftime(tide_ts, '%Y-%m-%d') FROM tides""")
    return o


def build_oracles(o: dict[str, str], with_views, news: str, hourly: str, weather: str) -> dict[str, str]:
    """Tables read back equal the queries they are built of; the build counts their rows."""
    same = {"curated_congestion_target": "congestion_target", "curated_vessel_state": "feature_vessel_state_hourly",
            "curated_port_status": "feature_port_status_hourly", "curated_port_status_v2": "feature_port_status_hourly_v2",
            "curated_dataset_v1": "dataset_v1"}
    out = {k: o[v] for k, v in same.items()}
    counted = [with_views(["positions"], "SELECT * FROM hpx", hourly), 
               with_views(["weather", "positions"], "SELECT * FROM weather_h", weather),
               with_views(["news"], "SELECT * FROM records", news), *(o[k] for k in (
                   "feature_vessel_inbound_hourly", "event_port_attribution_hourly", "feature_event_signals_hourly",
                   "feature_port_status_hourly", "congestion_target", "feature_vessel_state_hourly", "feature_port_status_hourly_v2"))]
    names = ["hourly_positions", "weather_hourly", "news_records", "feature_vessel_inbound_hourly", "event_port_attribution_hourly",
             "feature_event_signals_hourly", "feature_port_status_hourly", "congestion_target", "feature_vessel_state_hourly",
             "feature_port_status_hourly_v2"]
    out["build_all"] = " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INTEGER) AS step, '{n}' AS table_name, (SELECT count(*) FROM ({sql})) AS rows"
        for i, (n, sql) in enumerate(zip(names, counted, strict=True)))
    return out


def document_oracles(o: dict[str, str], with_views, asof: str, status: str) -> dict[str, str]:
    """Documents as DuckDB's JSON of the boards' own oracle texts.  ``status``: the port status table's oracle."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ports = ", ".join(f"({i}, {q(c)}, {q(n)}, {q(f)}, {la}::DOUBLE, {lo}::DOUBLE)" for i, (c, n, f, la, lo) in enumerate(R.PORTS))
    stamp = "strftime({}, '%Y-%m-%d %H:%M:%S.%g UTC')"
    boards = f"""docs AS (
  SELECT p.idx, p.code AS port_code, to_json({{'name': p.name, 'flag': p.flag, 'code': p.code, 'lat': p.lat, 'lon': p.lon,
    'metrics': {{'congestionPct': m.congestion_pct, 'waiting': m.waiting, 'avgSpeed': m.avg_speed, 'maxWave': m.max_wave,
                 'tracked': m.tracked, 'berthed': m.berthed}},
    'forecast': t.forecast, 'trend': t.trend, 'vessels': coalesce(v.ships, []), 'vesselsTotal': coalesce(v.n, 0),
    'aisDiagnostics': {{'status': d.status, 'message': d.message, 'detail': d.detail,
      'latestMessageWithin50nm': {stamp.format('d.latest_within_50nm')}, 'latestMessageWithin200nm': {stamp.format('d.latest_within_200nm')},
      'messageCountWithin50nm': d.messages_within_50nm, 'messageCountWithin200nm': d.messages_within_200nm,
      'providerMessageCount': d.messages_within_200nm, 'nearestDistanceNm': d.nearest_distance_nm,
      'secondSourceValidation': d.second_source_validation}},
    'berthAllocations': coalesce(b.berths, []), 'schedule': coalesce(s.rows, [])}})::VARCHAR AS document
  FROM (VALUES {ports}) AS p(idx, code, name, flag, lat, lon)
  LEFT JOIN ({o['board_metrics']}) m ON m.port_code = p.code
  LEFT JOIN ({o['trend_scores']}) t ON t.port_code = p.code
  LEFT JOIN ({o['coverage_diagnostics']}) d ON d.port_code = p.code
  LEFT JOIN (SELECT port_code, any_value(vessels_total) AS n,
               list({{'name': name, 'mmsi': CAST(mmsi AS VARCHAR), 'lat': round_even(lat, 4), 'lon': round_even(lon, 4), 'sog': speed,
                      'zone': zone, 'dist': dist, 'eta': eta, 'conf': conf}} ORDER BY list_rank) FILTER (list_rank <= 250) AS ships
             FROM ({o['vessel_list']}) GROUP BY port_code) v ON v.port_code = p.code
  LEFT JOIN (SELECT port_code, list({{'id': berth_id, 'name': name, 'status': status}} ORDER BY berth_id) AS berths
             FROM ({o['berth_occupancy']}) GROUP BY port_code) b ON b.port_code = p.code
  LEFT JOIN (SELECT port_code, list({{'vessel': vessel, 'mmsi': mmsi, 'type': type, 'status': status, 'eta': eta,
                                      'distance_nm': distance_nm}} ORDER BY schedule_rank) FILTER (schedule_rank <= 250) AS rows
             FROM ({o['arrival_schedule']}) GROUP BY port_code) s ON s.port_code = p.code)"""
    out = {"board_documents": f"WITH {boards} SELECT port_code, document FROM docs"}
    sources = ", ".join(f"({i}, {q(s)}, {q(n)}, {q(d)}, {c})" for i, (s, (n, _, d, c)) in enumerate(
        zip(["positions", "weather", "tides", "news"], R.BOARD_SOURCES, strict=True)))
    made = with_views(["ports", "positions"], f"SELECT strftime({asof}, '%Y-%m-%d %H:%M UTC') AS stamped")
    days = "(SELECT list(label ORDER BY position) FROM (" + o["day_labels"] + ") WHERE kind = '{}')"
    out["board_payload"] = f"""WITH {boards}
SELECT '{{"metadata":' || to_json({{'generatedAt': (SELECT stamped FROM ({made})), 'mode': 'batch-export'}})
  || ',"labels":' || to_json({{'trend': {days.format('trend')}, 'outlook': {days.format('outlook')}}})
  || ',"sources":' || (SELECT to_json(list({{'name': x.name, 'status': f.status, 'freshness': f.freshness, 'detail': x.detail,
       'contribution': x.share}} ORDER BY i)) FROM (VALUES {sources}) AS x(i, source, name, detail, share)
       JOIN ({o['source_freshness']}) f USING (source))
  || ',"ports":{{' || (SELECT string_agg('"' || port_code || '":' || document, ',' ORDER BY idx) FROM docs) || '}}}}' AS document"""
    names = ", ".join(R.FEATURES_V1)
    latest = f"SELECT port_code, observation_hour, {names} FROM ({status}) QUALIFY row_number() OVER (PARTITION BY port_code ORDER BY observation_hour DESC) = 1"
    out["latest_per_port"] = latest
    codes = ", ".join(f"({i}, {q(c)})" for i, (c, *_) in enumerate(R.PORTS))
    out["prediction_payload"] = f"""SELECT '{{"generatedAt":"' || (SELECT stamped FROM ({made})) || '","predictions":{{' ||
  string_agg('"' || code || '":' || CASE WHEN z.port_code IS NULL OR code = 'TWKHH' THEN 'null' ELSE to_json({{'port_code': code,
    'prediction': CAST(p >= 0.5 AS INTEGER), 'probability': round(p, 4),
    'as_of': strftime(observation_hour, '%Y-%m-%d %H:%M:%S.%g')}}) END, ',' ORDER BY i) || '}}}}' AS document
FROM (VALUES {codes}) AS c(i, code) LEFT JOIN (
  SELECT *, 1 / (1 + exp(1 - ifnull(vessels_at_anchor, 0) - ifnull(avg_wave_height_m, 0) / 2)) AS p FROM ({latest})) z ON z.port_code = c.code"""
    out["safe_cast_results"] = """SELECT event_id, round(ifnull(x, 0), 6) AS as_float, round(ifnull(x, -1), 6) AS or_minus_one,
  CAST(trunc(ifnull(x, 0)) AS BIGINT) AS as_int, CAST(trunc(ifnull(x, 7)) AS BIGINT) AS or_seven
FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN -event_id - 0.75::DOUBLE WHEN 4 THEN 10.0::DOUBLE * event_id
                            WHEN 6 THEN event_id / power(10, length(event_id::VARCHAR)) END AS x FROM events)"""
    return out


def place_oracles(o: dict[str, str], with_views) -> dict[str, str]:
    codes = """codes AS (
  SELECT c_custkey AS k, chr(CAST(65 + c_nationkey % 26 AS INTEGER)) || chr(CAST(65 + c_nationkey * 7 % 26 AS INTEGER)) AS country,
    CASE WHEN c_custkey % 29 = 0 THEN '' ELSE chr(CAST(65 + c_custkey % 20 AS INTEGER)) || chr(CAST(65 + c_custkey * 3 % 20 AS INTEGER)) || 'X' END
        AS location,
    (c_custkey % 90 + (c_custkey % 60) / 60) * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS lat,
    (c_custkey % 180 + (c_custkey * 7 % 60) / 60) * CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END AS lon
  FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 17 NOT IN (3, 5, 7))"""
    box = """round_even({lat} - 50 / 60, 4) AS lat_min, round_even({lat} + 50 / 60, 4) AS lat_max,
  round_even({lon} - 50 / 60 / greatest(cos(radians({lat})), 0.1), 4) AS lon_min,
  round_even({lon} + 50 / 60 / greatest(cos(radians({lat})), 0.1), 4) AS lon_max"""
    out = {"port_code_boxes": f"WITH {codes} SELECT country || location AS locode, {box.format(lat='lat', lon='lon')} FROM codes",
           "port_code_centres": f"""WITH {codes}
SELECT country || location AS locode, round_even(arg_max(lat, k), 4) AS lat, round_even(arg_max(lon, k), 4) AS lon
FROM codes WHERE location <> '' GROUP BY ALL"""}
    out["bbox_filter"] = with_views(["ports", "positions"], f"""SELECT event_id, round(v.lat, 6) AS lat, round(v.lon, 6) AS lon FROM positions v
SEMI JOIN (SELECT {box.format(lat='lat', lon='lon')} FROM ports) b
  ON v.lat BETWEEN b.lat_min AND b.lat_max AND v.lon BETWEEN b.lon_min AND b.lon_max""")
    stations = ", ".join(f"('{p}', '{s}')" for p, s in R.TIDE_STATIONS)
    out["station_lookup"] = f"""SELECT port_code, observation_hour, station_id FROM ({o['feature_vessel_inbound_hourly']})
JOIN (VALUES {stations}) AS s(port_code, station_id) USING (port_code)"""
    out["file_freshness"] = with_views(["weather", "tides"], """SELECT s.source, d.date,
  CASE WHEN d.date IS NULL THEN 'stale' ELSE 'active' END AS status, CASE WHEN d.date IS NOT NULL THEN true END AS has_age,
  d.date IS NOT NULL AS minutes
FROM (VALUES ('weather'), ('noaa_tides'), ('gdelt_events')) AS s(source) LEFT JOIN (
  SELECT source, max(date) AS date FROM (SELECT 'weather' AS source, date FROM weather
                                         UNION ALL SELECT 'noaa_tides', strftime(tide_ts, '%Y-%m-%d') FROM tides), 
       (SELECT CAST(max(CAST(date AS DATE)) + 1 AS DATE) AS today FROM weather)
  WHERE CAST(date AS DATE) IN (today, today - 1) GROUP BY source) d USING (source)""")
    return out
