"""Great-circle and flat distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.refdata import EARTH_RADIUS_NM


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def haversine_nm(lat, lon, port_lat, port_lon) -> Column:
    """Great-circle distance in nautical miles.

    The inner term is clamped to 1.0: unclamped rounding above 1 gives NaN.
    """
    lat, lon, port_lat, port_lon = _c(lat), _c(lon), _c(port_lat), _c(port_lon)
    a = (F.pow(F.sin(F.radians(lat - port_lat) / 2), 2)
         + F.cos(F.radians(port_lat)) * F.cos(F.radians(lat))
         * F.pow(F.sin(F.radians(lon - port_lon) / 2), 2))
    return F.lit(EARTH_RADIUS_NM) * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def equirect_nm(lat, lon, port_lat, port_lon) -> Column:
    """Flat distance: degrees scaled by cos(port latitude), times 60."""
    lat, lon, port_lat, port_lon = _c(lat), _c(lon), _c(port_lat), _c(port_lon)
    d_lat = lat - port_lat
    d_lon = (lon - port_lon) * F.cos(port_lat * F.lit(3.141592653589793) / 180)
    return F.sqrt(d_lat * d_lat + d_lon * d_lon) * 60


def radius_deg(radius_nm: float) -> float:
    """Angular radius in degrees of a circle of ``radius_nm`` on the sphere."""
    import math
    return math.degrees(radius_nm / EARTH_RADIUS_NM)
