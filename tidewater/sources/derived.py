"""Maritime inputs derived from the driver's tables by integer arithmetic.

The driver's parquet tables (events, orders, customer, nation) hold no maritime
data, so positions, voyages, weather, news, tides, macro and trade rows are
derived from them.  Each view is ONE SQL text that runs unchanged in Spark and
DuckDB except for the names in ``DIALECT``; Spark runs it through
``spark.sql(text, **dataframes)`` (no global temp views), DuckDB puts the same
texts in front of an oracle query as CTEs.  Work grows with the driver tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewater import refdata as R

DIALECT = {
    "spark": {"NTZ": "TIMESTAMP_NTZ"},
    "duckdb": {"NTZ": "TIMESTAMP"},
}

# --- Fixed values: derived news phrases (query) and places, selected by event_id % 5 and % 6 ---
NEWS_PHRASES = [
    ("Dockworker strike halts port terminal", "labor"),
    ("Customs tariff delays container freight", "trade_policy"),
    ("Vessel attack raises shipping risk", "conflict_security"),
    ("Terminal outage and congestion at harbor", "infrastructure"),
    ("Election polling shows a close race", "labor"),
]
NEWS_PLACES = ["Rotterdam", "in the US", "German coast", "near Port of LA and Shanghai", "worldwide", "Customs"]


def _ports_values() -> str:
    rows = ",\n        ".join(
        f"('{code}', '{name}', {i}, {lat}, {lon})" for i, (code, name, _flag, lat, lon) in enumerate(R.PORTS))
    return rows


def _news_phrase_values() -> str:
    return ", ".join(f"({i}, '{p}', '{q}')" for i, (p, q) in enumerate(NEWS_PHRASES))


def _news_place_values() -> str:
    return ", ".join(f"({i}, '{p}')" for i, p in enumerate(NEWS_PLACES))


VIEW_SQL: dict[str, str] = {
    "ports": f"""
SELECT port_code, port_name, CAST(port_idx AS INT) AS port_idx,
       CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon
FROM (VALUES
        {_ports_values()}
) AS t(port_code, port_name, port_idx, lat, lon)""",
    "positions": """
SELECT e.event_id,
       200000000 + e.user_id AS mmsi,
       concat('SHIP ', CAST(e.user_id AS STRING)) AS ship_name,
       p.lat + CAST((e.event_id * 7919) % 2001 - 1000 AS DOUBLE) / 1000 AS lat,
       p.lon + CAST((e.event_id * 104729) % 2001 - 1000 AS DOUBLE) / 1000 AS lon,
       CASE WHEN e.event_id % 4 = 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(e.event_id % 220 AS DOUBLE) / 10 END AS sog,
       CAST(e.event_id % 360 AS DOUBLE) AS cog,
       CAST(511 AS INT) AS true_heading,
       CAST(CASE e.event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 ELSE 15 END AS INT)
           AS nav_status,
       'PositionReport' AS msg_type,
       e.ts AS received_at,
       CAST(CAST(e.ts AS DATE) AS STRING) AS date
FROM {events} e JOIN {ports} p ON p.port_idx = e.user_id % 10""",
    "voyage": """
SELECT e.event_id,
       200000000 + e.user_id AS mmsi,
       CASE e.event_id % 4 WHEN 0 THEN concat('TO ', p.port_code) WHEN 1 THEN lower(p.port_name)
            WHEN 2 THEN 'ORDERS' END AS destination,
       CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE e.ts + (e.event_id % 96) * INTERVAL '1' HOUR END AS eta_ts,
       CASE WHEN e.event_id % 6 = 0 THEN NULL ELSE CAST(50 + e.event_id % 100 AS DOUBLE) / 10 END AS draught_m,
       CAST(60 + e.event_id % 30 AS STRING) AS ship_type,
       e.ts AS received_at,
       CAST(CAST(e.ts AS DATE) AS STRING) AS date
FROM {events} e JOIN {ports} p ON p.port_idx = e.user_id % 10
WHERE e.event_type = 'signup'""",
    "weather": """
SELECT p.port_code,
       CAST(date_trunc('hour', e.ts) AS {NTZ}) AS obs_hour,
       CAST(e.event_id % 500 AS DOUBLE) / 100 AS wave_height_m,
       CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE CAST(e.event_id % 300 AS DOUBLE) / 100 END AS wind_wave_height_m,
       e.event_id AS event_id,
       e.ts AS fetched_at,
       CAST(CAST(e.ts AS DATE) AS STRING) AS date
FROM {events} e JOIN {ports} p ON p.port_idx = e.event_id % 10
WHERE e.event_type = 'view'""",
    "news": f"""
SELECT e.event_id,
       concat(ph.phrase, ' ', pl.place) AS title,
       concat('https://example.com/', CAST(e.event_id % 400 AS STRING)) AS url,
       CASE WHEN e.event_id % 10 = 0 THEN NULL ELSE e.ts END AS seen_at,
       e.ts + (e.event_id % 3) * INTERVAL '1' HOUR AS fetched_at,
       ph.query_name
FROM {{events}} e
JOIN (VALUES {_news_phrase_values()}) AS ph(idx, phrase, query_name) ON ph.idx = e.event_id % 5
JOIN (VALUES {_news_place_values()}) AS pl(idx, place) ON pl.idx = e.event_id % 6
WHERE e.event_type = 'click'""",
    "tides": """
SELECT e.event_id,
       CASE WHEN e.event_id % 2 = 0 THEN 'USLAX' ELSE 'USNYC' END AS port_code,
       e.ts AS tide_ts,
       CAST(e.event_id % 300 - 50 AS DOUBLE) / 100 AS tide_level_m,
       CASE WHEN e.event_id % 11 = 0 THEN 'HH' WHEN e.event_id % 4 < 2 THEN 'H' ELSE 'L' END AS tide_type
FROM {events} e
WHERE e.event_type = 'purchase'""",
    "macro": """
SELECT o_orderkey,
       CASE o_orderkey % 4 WHEN 0 THEN 'GSCPI' WHEN 1 THEN 'DCOILWTICO' WHEN 2 THEN 'DTWEXBGS' ELSE 'OTHER' END
           AS series_id,
       CAST(o_orderdate AS DATE) AS obs_date,
       CASE WHEN o_orderkey % 17 = 0 THEN '.' ELSE CAST(o_orderkey % 1000 AS STRING) END AS value_text
FROM {orders}""",
    "trade": """
SELECT o.o_orderkey,
       n.n_name AS reporter,
       CAST(o.o_custkey % 100 AS STRING) AS cmd_code,
       CAST(date_trunc('month', o.o_orderdate) AS {NTZ}) AS period,
       o.o_totalprice AS primary_value
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
}

# dependencies of each view (driver tables or other views)
VIEW_DEPS: dict[str, list[str]] = {
    "ports": [],
    "positions": ["events", "ports"],
    "voyage": ["events", "ports"],
    "weather": ["events", "ports"],
    "news": ["events"],
    "tides": ["events"],
    "macro": ["orders"],
    "trade": ["orders", "customer", "nation"],
}
VIEW_ORDER = ["ports", "positions", "voyage", "weather", "news", "tides", "macro", "trade"]


def view_sql(name: str, dialect: str) -> str:
    """The view text for one engine; ``{table}`` references stay as placeholders for Spark."""
    text = VIEW_SQL[name]
    names = dict(DIALECT[dialect])
    if dialect == "duckdb":
        names.update({d: d for d in VIEW_DEPS[name]})
        return text.format(**names)
    names.update({d: "{" + d + "}" for d in VIEW_DEPS[name]})
    return text.format(**names)


def duckdb_ctes(names: list[str] | None = None) -> str:
    """WITH-clause body defining the derived views for an oracle query."""
    wanted = set(VIEW_ORDER if names is None else names)
    # pull in dependencies
    changed = True
    while changed:
        changed = False
        for n in list(wanted):
            for d in VIEW_DEPS.get(n, []):
                if d in VIEW_SQL and d not in wanted:
                    wanted.add(d)
                    changed = True
    parts = [f"{n} AS ({view_sql(n, 'duckdb')}\n)" for n in VIEW_ORDER if n in wanted]
    return ",\n".join(parts)


@dataclass
class Inputs:
    """Driver tables of one scale directory plus the derived maritime views."""

    spark: SparkSession
    sf_dir: str
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        key = "t:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._cache[key]

    def view(self, name: str) -> DataFrame:
        key = "v:" + name
        if key not in self._cache:
            deps = {d: (self.view(d) if d in VIEW_SQL else self.table(d)) for d in VIEW_DEPS[name]}
            self._cache[key] = self.spark.sql(view_sql(name, "spark"), **deps)
        return self._cache[key]

    # convenience accessors
    @property
    def ports(self) -> DataFrame:
        return self.view("ports")

    @property
    def positions(self) -> DataFrame:
        return self.view("positions")

    @property
    def voyage(self) -> DataFrame:
        return self.view("voyage")

    @property
    def weather(self) -> DataFrame:
        return self.view("weather")

    @property
    def news(self) -> DataFrame:
        return self.view("news")

    @property
    def tides(self) -> DataFrame:
        return self.view("tides")

    @property
    def macro(self) -> DataFrame:
        return self.view("macro")

    @property
    def trade(self) -> DataFrame:
        return self.view("trade")
