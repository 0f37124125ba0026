"""Rule cards as Column expressions.

All are CASE chains or arithmetic over columns; first match wins.  No UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import refdata as R


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def py_round(x, digits: int = 0) -> Column:
    """Half-even rounding after scaling by a power of ten.

    Equal to Python's ``round`` except next to a tie: the scaled product can be a tie although the double itself is
    not (0.15 and 0.35 with one digit, 2.675 with two give 0.2, 0.4 and 2.68; Python 0.1, 0.3 and 2.67).
    """
    f = float(10 ** digits)
    return F.bround(_c(x) * F.lit(f), 0) / F.lit(f)


# --- F4 / F5 -----------------------------------------------------------------

def destination_matches(destination, port_code, port_name) -> Column:
    """Destination contains the code, the name, or the code from position 3; null -> false."""
    d = F.lower(_c(destination))
    code, name = F.lower(_c(port_code)), F.lower(_c(port_name))
    hit = F.contains(d, code) | F.contains(d, name) | F.contains(d, F.substring(code, F.lit(3), F.length(code)))
    return F.when(_c(destination).isNull(), F.lit(False)).when(hit, F.lit(True)).otherwise(F.lit(False))


def eta_within(eta, hour, hours: int = 48) -> Column:
    """ETA in [hour, hour + N h]; null -> false."""
    e, h = _c(eta), _c(hour)
    upper = h + F.make_dt_interval(F.lit(0), F.lit(hours))
    return F.when(e.isNull(), F.lit(False)).when(e.between(h, upper), F.lit(True)).otherwise(F.lit(False))


# --- X6 vessel state -----------------------------------------------------------

def vessel_state(distance, sog, nav_status, delta, dest_match=None, eta_ok=None) -> Column:
    d, dl = _c(distance), _c(delta)
    nav = F.coalesce(_c(nav_status), F.lit(15))
    s = F.coalesce(_c(sog), F.lit(0.0))
    intent = (_c(dest_match) & _c(eta_ok)) if dest_match is not None else F.lit(False)
    return (F.when((d <= 15) & (nav == 5), "at_berth")
            .when(dl > 0.5, "outbound")
            .when((d <= 30) & ((nav == 1) | ((s <= 0.5) & (dl.isNull() | (dl <= 0.25)))), "waiting_anchor")
            .when((dl < -0.5) | intent, "inbound")
            .otherwise("transit_unknown"))


# --- X7 nav status -------------------------------------------------------------

def nav_status_code(nav) -> Column:
    """Text or int -> int code, else null."""
    return _try_int(F.trim(_c(nav).cast("string")))


def _try_int(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.cast("int"))


# --- X8 - X12 board vessel rules --------------------------------------------------

def display_zone(dist, speed, nav_status) -> Column:
    """berth / anchor / approaching / transit on 1-decimal distance and speed."""
    d, s = _c(dist), _c(speed)
    txt = F.lower(F.trim(_c(nav_status).cast("string")))
    code = nav_status_code(nav_status)
    moored = F.coalesce(F.contains(txt, F.lit("moored")), F.lit(False)) | F.coalesce(code == 5, F.lit(False))
    anchored = F.coalesce(F.contains(txt, F.lit("anchor")), F.lit(False)) | F.coalesce(code == 1, F.lit(False))
    return (F.when(moored & (d <= 15), "berth")
            .when(anchored & (d <= 30), "anchor")
            .when((s <= 0.3) & (d <= 5), "anchor")
            .when(d <= 50, "approaching")
            .otherwise("transit"))


def live_zone(dist, sog) -> Column:
    """Simplified zone of the live map."""
    d, s = _c(dist), _c(sog)
    return (F.when((d <= 2) & (s < 1), "berth")
            .when((d <= 5) & (s < 1), "anchor")
            .when(d <= 30, "approaching")
            .otherwise("transit"))


def priority_class(dist, sog, nav_status) -> Column:
    """0 moored, 1 anchored or slow, 2 within 50 nm, 3 other."""
    nav = F.coalesce(_c(nav_status), F.lit(15))
    s = F.coalesce(_c(sog), F.lit(0.0))
    return (F.when(nav == 5, 0).when((nav == 1) | (s <= 1), 1).when(_c(dist) <= 50, 2).otherwise(3))


def eta_text(dist, speed, zone) -> Column:
    """Berthed / Waiting / Unknown / >72h / 'Hh MMm' (X11); minutes round half-even, so '1h 60m' can occur."""
    d, s, z = _c(dist), _c(speed), _c(zone)
    hours = F.try_divide(d, s)
    whole = F.floor(hours)
    minutes = py_round((hours - whole) * 60, 0)
    return (F.when(z == "berth", "Berthed")
            .when(z == "anchor", "Waiting")
            .when(s <= 1.0, "Unknown")
            .when(hours > 72, ">72h")
            .otherwise(F.format_string("%dh %02dm", whole.cast("int"), minutes.cast("int"))))


def confidence(dist, speed, zone) -> Column:
    """45-99 confidence score."""
    d, s, z = _c(dist), _c(speed), _c(zone)
    score = (F.lit(92)
             - F.when(d > 120, 18).when(d > 60, 10).otherwise(0)
             - F.when(s < 4, 18).when(s < 8, 8).otherwise(0))
    return F.when(z.isin("berth", "anchor"), F.lit(99)).otherwise(F.greatest(F.lit(45), F.least(F.lit(99), score)))


def congestion_score(total, anchored, avg_speed, max_wave) -> Column:
    """0-1 weighted score, 2 decimals half-even."""
    t, a, sp, wv = _c(total).cast("double"), _c(anchored).cast("double"), _c(avg_speed), _c(max_wave)
    ratio = F.least(F.lit(1.0), F.try_divide(a, t))
    wave = F.least(F.lit(1.0), wv / 3.0)
    speed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 6.0 - sp) / 6.0)
    raw = F.least(F.lit(1.0), 0.65 * ratio + 0.25 * wave + 0.10 * speed)
    return F.when(t <= 0, F.lit(0.0)).otherwise(py_round(raw, 2))


def coverage_status(port_code, messages_50nm, messages_200nm) -> Column:
    """override / active / nearby_only / no_provider_messages."""
    code = _c(port_code)
    m50, m200 = F.coalesce(_c(messages_50nm), F.lit(0)), F.coalesce(_c(messages_200nm), F.lit(0))
    expr = None
    for pc, (status, _m, _d, _v) in R.AIS_COVERAGE_OVERRIDES.items():
        expr = F.when(code == pc, status) if expr is None else expr.when(code == pc, status)
    base = expr if expr is not None else F
    return (base.when(m50 > 0, "active").when(m200 > 0, "nearby_only").otherwise("no_provider_messages"))


def coverage_field(port_code, status, index: int) -> Column:
    """Message (0), detail (1) or second-source advice (2) for a coverage status."""
    code, st = _c(port_code), _c(status)
    expr = None
    for pc, vals in R.AIS_COVERAGE_OVERRIDES.items():
        cond = code == pc
        expr = F.when(cond, vals[1 + index]) if expr is None else expr.when(cond, vals[1 + index])
    for name, vals in R.COVERAGE_TEXT.items():
        expr = expr.when(st == name, vals[index])
    return expr


def freshness_label(age_minutes) -> Column:
    """'N min ago' / 'Nh ago' / 'Nd ago' / 'unavailable' (X15)."""
    a = _c(age_minutes)
    return (F.when(a.isNull(), "unavailable")
            .when(a < 120, F.format_string("%d min ago", F.floor(a).cast("int")))
            .when(a < 1440, F.format_string("%dh ago", F.floor(a / 60).cast("int")))
            .otherwise(F.format_string("%dd ago", F.floor(a / 1440).cast("int"))))


def freshness_status(age_minutes) -> Column:
    a = _c(age_minutes)
    return F.when(a.isNotNull() & (a < 120), "active").otherwise("stale")


def freshness_age_hours(label) -> Column:
    """Label text -> age in hours, null when it does not parse."""
    t = _c(label)
    pat = r"(?i)^(\d+)\s*(min|h|d)\s+ago$"
    num = F.regexp_extract(t, pat, 1)
    unit = F.lower(F.regexp_extract(t, pat, 2))
    v = F.when(num != "", num.cast("double"))
    return (F.when(~t.rlike(pat) | t.isNull(), F.lit(None).cast("double"))
            .when(unit == "min", v / 60).when(unit == "h", v).otherwise(v * 24))


def freshness_severe(status, age_hours) -> Column:
    """Banner is severe when the source is not active and its age is unknown or over 12 h."""
    return (_c(status) != "active") & (_c(age_hours).isNull() | (_c(age_hours) > 12))


def risk_tier(pct) -> Column:
    """High >= 65, Elevated >= 35, else Nominal."""
    p = _c(pct)
    return F.when(p >= 65, "High").when(p >= 35, "Elevated").otherwise("Nominal")


def pressure_label(coverage_issue, has_snapshot, waiting, congestion_pct, tracked) -> Column:
    """Coverage limited / Covered / High pressure / Watch / Traffic visible / Clear."""
    w, c, t = (F.coalesce(_c(x), F.lit(0)) for x in (waiting, congestion_pct, tracked))
    return (F.when(_c(coverage_issue), "Coverage limited")
            .when(~_c(has_snapshot), "Covered")
            .when(w >= 10, "High pressure")
            .when((w > 0) | (c >= 50), "Watch")
            .when(t > 0, "Traffic visible")
            .otherwise("Clear"))


def anchor_severity(waiting) -> Column:
    """No vessels waiting / Moderate queue / High congestion at >= 10."""
    w = _c(waiting)
    return F.when(w == 0, "No vessels waiting").when(w >= 10, "High congestion").otherwise("Moderate queue")


def schedule_status(zone) -> Column:
    """Berthed / Waiting / Approaching / In Transit."""
    z = _c(zone)
    return (F.when(z == "berth", "Berthed").when(z == "anchor", "Waiting")
            .when(z == "approaching", "Approaching").otherwise("In Transit"))


def name_fallback(ship_name, mmsi) -> Column:
    """Ship name, or 'MMSI n' when blank."""
    return F.coalesce(F.nullif(_c(ship_name), F.lit("")), F.concat(F.lit("MMSI "), _c(mmsi).cast("string")))


def eta_hours(dist, sog) -> Column:
    """Numeric ETA for sorting; +inf below 0.5 kn."""
    s = F.coalesce(_c(sog), F.lit(0.0))
    return F.when(s < 0.5, F.lit(float("inf"))).otherwise(F.coalesce(_c(dist), F.lit(0.0)) / s)


def zone_ordinal(zone) -> Column:
    """berth 0, anchor 1, approaching 2, transit 3, other 99 (T5)."""
    z = _c(zone)
    expr = F.when(z == R.ZONE_ORDER[0], 0)
    for i, name in enumerate(R.ZONE_ORDER[1:], start=1):
        expr = expr.when(z == name, i)
    return expr.otherwise(99)


def distance_bucket(dist) -> Column:
    """0-10, 10-50, 50-100, 100-150, 150-200 nm; upper bounds inclusive."""
    d = _c(dist)
    return (F.when(d <= 10, "0-10 nm").when(d <= 50, "10-50 nm").when(d <= 100, "50-100 nm")
            .when(d <= 150, "100-150 nm").otherwise("150-200 nm"))
