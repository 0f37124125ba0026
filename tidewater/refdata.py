"""Fixed reference values.

Everything in this module is a FIXED VALUE that must equal the source pipeline's
constants for results to agree: the ten pilot ports, their terminals, the news
term dictionaries and the coverage override.  They are stated plainly, in their
natural order, and used as small broadcast dimensions or literal arrays.
"""

from __future__ import annotations

# --- Fixed values: pilot ports (code, name, flag, lat, lon), in dimension order ---
PORTS: list[tuple[str, str, str, float, float]] = [
    ("NLRTM", "Rotterdam", "NL", 51.9225, 4.4792),
    ("SGSIN", "Singapore", "SG", 1.2644, 103.8198),
    ("USLAX", "Los Angeles", "US", 33.7405, -118.2728),
    ("CNSHA", "Shanghai", "CN", 30.6267, 121.9851),
    ("DEHAM", "Hamburg", "DE", 53.5425, 9.9663),
    ("BEANR", "Antwerp", "BE", 51.2194, 4.4025),
    ("GBFXT", "Felixstowe", "GB", 51.9500, 1.3500),
    ("AEDXB", "Dubai", "AE", 24.9857, 55.0272),
    ("USNYC", "New York", "US", 40.6892, -74.0445),
    ("TWKHH", "Kaohsiung", "TW", 22.6163, 120.2650),
]

# --- Fixed values: verified terminal names per port (others have none) ---
PORT_TERMINALS: dict[str, list[str]] = {
    "NLRTM": ["Euromax Terminal", "ECT Delta", "APM Terminals", "RWG", "Maasvlakte 2", "Botlek"],
    "SGSIN": ["Pasir Panjang T1", "Pasir Panjang T2", "Keppel", "Brani", "Tanjong Pagar", "Tuas Mega Port"],
    "USLAX": ["Pier 400", "Trapac", "YTI", "WBCT", "Everport", "Fenix Marine"],
}

# --- Fixed values: radii and limits (nautical miles, counts) ---
EARTH_RADIUS_NM = 3440.065
INBOUND_RADIUS_NM = 200.0
SURFACED_VESSEL_RADIUS_NM = 50.0
DIAGNOSTIC_RADIUS_NM = 200.0
CAPTURE_BOX_HALF_WIDTH_NM = 50.0
LIVE_BOX_DELTA_DEG = 0.83

# --- Fixed values: news queries, in fetch order ---
EVENT_QUERIES: list[tuple[str, str]] = [
    ("labor", "(port OR shipping OR maritime OR dockworker OR longshore OR terminal) "
              "(strike OR protest OR blockade OR labor)"),
    ("conflict_security", "(port OR shipping OR maritime OR vessel OR container) "
                          "(war OR conflict OR attack OR sanction OR blockade)"),
    ("infrastructure", "(port OR terminal OR shipping) "
                       "(closure OR congestion OR accident OR explosion OR outage)"),
    ("trade_policy", "(shipping OR container OR freight OR port) "
                     "(tariff OR customs OR embargo OR sanctions)"),
]

# --- Fixed values: news term dictionaries ---
MARITIME_TERMS = ["anchorage", "berth", "cargo", "container", "dock", "freight", "harbor",
                  "harbour", "maritime", "port", "shipping", "terminal", "vessel"]

# category order matters: ties on match count go to the query's category, then to this order
CATEGORY_TERMS: list[tuple[str, list[str]]] = [
    ("labor", ["strike", "labor", "labour", "dockworker", "longshore", "protest"]),
    ("conflict_security", ["attack", "blockade", "conflict", "embargo", "sanction", "sanctions", "war"]),
    ("infrastructure", ["accident", "closure", "congestion", "explosion", "outage", "shutdown"]),
    ("trade_policy", ["customs", "tariff", "tariffs", "trade", "policy"]),
]

HIGH_SEVERITY_TERMS = ["attack", "blockade", "closure", "embargo", "explosion", "sanction",
                       "sanctions", "shutdown", "strike", "war"]
MEDIUM_SEVERITY_TERMS = ["accident", "congestion", "customs", "delay", "delays", "labor",
                         "labour", "outage", "protest", "tariff"]

# port attribution rules: (code, name, port terms in priority order, country terms in priority order)
PORT_RULES: list[tuple[str, str, list[str], list[str]]] = [
    ("NLRTM", "Rotterdam", ["rotterdam", "maasvlakte"], ["netherlands", "dutch"]),
    ("SGSIN", "Singapore", ["singapore", "tuas", "pasir panjang"], ["singapore"]),
    ("USLAX", "Los Angeles", ["los angeles", "port of la", "san pedro"],
     ["united states", "u.s.", "us ", "american"]),
    ("CNSHA", "Shanghai", ["shanghai", "yangshan"], ["china", "chinese"]),
    ("DEHAM", "Hamburg", ["hamburg"], ["germany", "german"]),
    ("BEANR", "Antwerp", ["antwerp", "antwerpen"], ["belgium", "belgian"]),
    ("GBFXT", "Felixstowe", ["felixstowe"], ["united kingdom", "uk ", "britain", "british"]),
    ("AEDXB", "Dubai", ["dubai", "jebel ali"], ["united arab emirates", "uae", "emirati"]),
    ("USNYC", "New York", ["new york", "new jersey", "port of ny", "port of nj"],
     ["united states", "u.s.", "us ", "american"]),
    ("TWKHH", "Kaohsiung", ["kaohsiung"], ["taiwan", "taiwanese"]),
]

NEWS_SOURCE = "gdelt_doc"
SEVERE_EVENT_THRESHOLD = 0.8

# --- Fixed values: coverage override (status, message, detail, second-source validation) ---
AIS_COVERAGE_OVERRIDES: dict[str, tuple[str, str, str, str]] = {
    "AEDXB": (
        "coverage_limited",
        "No AIS messages received from provider.",
        "AISStream coverage for Dubai/Jebel Ali is currently limited in the UAE/Gulf feed; "
        "validate with a second AIS source before claiming live tracking.",
        "required",
    ),
}

COVERAGE_TEXT: dict[str, tuple[str, str, str]] = {
    "active": ("AIS messages received from provider.",
               "Recent provider messages are available within the live dashboard radius.",
               "not_required"),
    "nearby_only": ("No AIS messages received within 50nm.",
                    "Provider messages exist within 200nm, but not in the live dashboard radius.",
                    "not_required"),
    "no_provider_messages": ("No AIS messages received from provider.",
                             "No recent provider messages were found within 200nm of this port.",
                             "recommended"),
}

# --- Fixed values: board data sources (name, raw prefix, detail, contribution percent) ---
BOARD_SOURCES: list[tuple[str, str, str, int]] = [
    ("AIS Vessel Positions", "raw/source=ais/", "Hourly AIS snapshots near selected ports", 55),
    ("Marine Weather", "raw/source=weather/", "Wave and marine conditions from Open-Meteo", 30),
    ("NOAA Tides", "raw/source=noaa_tides/", "US tidal predictions from NOAA CO-OPS", 15),
    ("GDELT Maritime Events", "raw/source=gdelt_events/", "News-derived disruption events from GDELT DOC", 10),
]

# --- Fixed values: tide stations per port (ports without a station give no rows) ---
TIDE_STATIONS: list[tuple[str, str]] = [
    ("USLAX", "9410660"),
    ("USLGB", "9410660"),
    ("USNYC", "8518750"),
    ("USFPG", "8452660"),
]

# --- Fixed values: AIS message types ---
POSITION_MESSAGE_TYPES = ["PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport"]
VOYAGE_MESSAGE_TYPES = ["ShipStaticData", "StaticDataReport", "ShipStaticAndVoyageData",
                        "ShipStaticAndVoyageRelatedData", "VoyageData"]

# --- Fixed values: model feature contracts ---
FEATURES_V1 = ["vessels_in_10nm", "vessels_in_50nm", "vessels_in_200nm", "avg_speed_50nm",
               "vessels_at_anchor", "avg_wave_height_m", "hour_of_day", "day_of_week"]
FEATURES_V2 = FEATURES_V1 + ["vessels_at_berth", "vessels_waiting_anchor", "vessels_inbound",
                             "vessels_outbound", "vessels_transit_unknown", "destination_match_48h_count",
                             "avg_distance_delta_nm", "avg_draught_waiting_anchor"]
TARGET = "is_congested_24h"

# --- Fixed values: board zone order ---
ZONE_ORDER = ["berth", "anchor", "approaching", "transit"]

#: Alarm limits (fixed values): the greatest age in minutes, the least rows of an hour.
ALARM_LIMITS = [("positions", "age_minutes", 90.0), ("boards", "age_minutes", 120.0), ("positions", "rows_per_hour", 1.0)]
