"""Spatial joins: grid-keyed distance join (J2), point-in-polygon (J14, J15), box filter.

No cross product is ever built.  The distance join keys both sides by a
lat/lon grid cell whose size is the search radius; each site is exploded to
the cells its exact search box touches, so the join is an equi-join on the
cell key, followed by the exact haversine filter.  No side is hinted: Spark
broadcasts one below its byte threshold, else shuffles, and AQE splits skew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.geo import haversine_nm, radius_deg
from tidewater.refdata import EARTH_RADIUS_NM

def _grid(radius_nm: float) -> tuple[float, int]:
    """Cell size in degrees (divides 360 exactly, not larger than the radius) and column count."""
    delta = radius_deg(radius_nm)
    ncols = max(1, math.ceil(360.0 / delta))
    return 360.0 / ncols, ncols


def point_cells(lat: Column, lon: Column, radius_nm: float) -> tuple[Column, Column]:
    cell, ncols = _grid(radius_nm)
    cy = F.floor((lat + 90.0) / cell)
    cx = F.pmod(F.floor((lon + 180.0) / cell), F.lit(ncols))
    return cy, cx


def site_cells(lat: Column, lon: Column, radius_nm: float) -> tuple[Column, Column]:
    """Arrays of the cell rows / columns covering a site's exact search box.

    Latitude: +-delta.  Longitude: +-asin(sin delta / cos lat), all longitudes
    near the poles (cos lat <= sin delta); cell numbers wrap at +-180.
    """
    cell, ncols = _grid(radius_nm)
    # tiny outward margin so floating rounding at the box edge loses no pair
    d_rad = radius_nm / EARTH_RADIUS_NM * (1 + 1e-9) + 1e-12
    d_deg = math.degrees(d_rad)
    cos_lat = F.cos(F.radians(lat))
    polar = cos_lat <= F.lit(math.sin(d_rad))
    dlon = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(d_rad)) / cos_lat))) + F.lit(1e-9)
    rows = F.sequence(F.floor((lat - d_deg + 90.0) / cell), F.floor((lat + d_deg + 90.0) / cell))
    lo = F.floor((lon - dlon + 180.0) / cell)
    hi = F.floor((lon + dlon + 180.0) / cell)
    cols = F.when(polar | (hi - lo + 1 >= ncols), F.sequence(F.lit(0).cast("bigint"), F.lit(ncols - 1).cast("bigint"))) \
        .otherwise(F.array_distinct(F.transform(F.sequence(lo, hi), lambda x: F.pmod(x, F.lit(ncols).cast("bigint")))))
    return rows, cols


def distance_join(points: DataFrame, sites: DataFrame, radius_nm: float, *,
                  lat: str = "lat", lon: str = "lon",
                  site_lat: str = "port_lat", site_lon: str = "port_lon",
                  distance_col: str = "distance_nm") -> DataFrame:
    """All (point, site) pairs with great-circle distance <= radius_nm."""
    cy, cx = point_cells(F.col(lat), F.col(lon), radius_nm)
    p = points.withColumn("_cy", cy).withColumn("_cx", cx)
    rows, cols = site_cells(F.col(site_lat), F.col(site_lon), radius_nm)
    s = (sites.withColumn("_cy", F.explode(rows))
         .withColumn("_cx", F.explode(cols)))
    joined = p.join(s, ["_cy", "_cx"], "inner").drop("_cy", "_cx")
    return (joined.withColumn(distance_col, haversine_nm(F.col(lat), F.col(lon), F.col(site_lat), F.col(site_lon)))
            .filter(F.col(distance_col) <= F.lit(float(radius_nm))))


def nearest_in_reach(points: DataFrame, sites: DataFrame, radius_nm: float, *, lat: str = "lat", lon: str = "lon",
                     site_lat: str = "port_lat", site_lon: str = "port_lon", site_col: str = "port_code",
                     distance_col: str = "distance_nm") -> DataFrame:
    """Every point with its nearest site within ``radius_nm`` and the distance; nulls without one (J3).  Ties go to the smaller code.

    Sites are gathered into one list per grid cell (as many as have the cell in reach), so a point meets one row and the nearest
    is a minimum inside it: points are neither multiplied nor shuffled again by a key of their own.
    """
    cy, cx = point_cells(F.col(lat), F.col(lon), radius_nm)
    rows, cols = site_cells(F.col(site_lat), F.col(site_lon), radius_nm)
    cells = (sites.withColumn("_cy", F.explode(rows)).withColumn("_cx", F.explode(cols)).groupBy("_cy", "_cx")
             .agg(F.collect_list(F.struct(F.col(site_col).alias("code"), F.col(site_lat).alias("y"), F.col(site_lon).alias("x"))).alias("_sites")))
    j = points.withColumn("_cy", cy).withColumn("_cx", cx).join(cells, ["_cy", "_cx"], "left")
    far = F.transform("_sites", lambda s: F.struct(haversine_nm(F.col(lat), F.col(lon), s["y"], s["x"]).alias("d"), s["code"].alias("code")))
    nearest = F.array_min(F.filter(far, lambda t: t["d"] <= F.lit(float(radius_nm))))
    return j.withColumn("_near", nearest).select(*points.columns, F.col("_near.code").alias(site_col), F.col("_near.d").alias(distance_col))


def nearest_site(pairs: DataFrame, key_cols: list[str], distance_col: str = "distance_nm",
                 site_col: str = "port_code") -> DataFrame:
    """Keep the closest site per key (J3): min_by over (distance, site code) as tie-break.

    A grouped aggregate with partial aggregation; no window over a hot key.
    """
    others = [c for c in pairs.columns if c not in key_cols]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col(distance_col), F.col(site_col)))
    return pairs.groupBy(*key_cols).agg(best.alias("_b")).select(*key_cols, "_b.*")


# ---------------------------------------------------------------------------
# point in polygon
# ---------------------------------------------------------------------------

def zone_edges(zones: DataFrame, rings_col: str = "rings") -> DataFrame:
    """Add per-zone bbox and ring edge arrays from ``rings`` (array<array<array<double>>>, lon/lat)."""
    def ring_edges(ring):
        n = F.size(ring)
        idx = F.sequence(F.lit(0), n - 1)
        return F.transform(idx, lambda i: F.struct(
            F.element_at(ring, F.when(i == 0, n).otherwise(i))[0].alias("x1"),
            F.element_at(ring, F.when(i == 0, n).otherwise(i))[1].alias("y1"),
            F.element_at(ring, i + 1)[0].alias("x2"),
            F.element_at(ring, i + 1)[1].alias("y2")))

    outer = F.element_at(F.col(rings_col), 1)
    return (zones
            .withColumn("outer_edges", ring_edges(outer))
            .withColumn("outer_points", F.size(outer))
            .withColumn("holes", F.transform(F.slice(F.col(rings_col), F.lit(2), F.size(F.col(rings_col))),
                                             lambda r: F.struct(F.size(r).alias("n"), ring_edges(r).alias("edges"))))
            .withColumn("min_lon", F.array_min(F.transform(outer, lambda p: p[0])))
            .withColumn("max_lon", F.array_max(F.transform(outer, lambda p: p[0])))
            .withColumn("min_lat", F.array_min(F.transform(outer, lambda p: p[1])))
            .withColumn("max_lat", F.array_max(F.transform(outer, lambda p: p[1]))))


def _inside_ring(edges: Column, n_points: Column, lon: Column, lat: Column) -> Column:
    """Even-odd ray casting as an array expression: count edges crossed to the east."""
    crossings = F.filter(edges, lambda e: ((e["y2"] > lat) != (e["y1"] > lat)) & (
        lon < F.try_divide((e["x1"] - e["x2"]) * (lat - e["y2"]), e["y1"] - e["y2"]) + e["x2"]))
    return (n_points >= 4) & (F.size(crossings) % 2 == 1)


def point_in_zone(lon: Column, lat: Column) -> Column:
    """Inside the outer ring and in no hole (expects ``zone_edges`` columns in scope)."""
    in_outer = _inside_ring(F.col("outer_edges"), F.col("outer_points"), lon, lat)
    in_hole = F.exists(F.col("holes"), lambda h: _inside_ring(h["edges"], h["n"], lon, lat))
    return in_outer & ~in_hole


ZONE_CELL_DEG = 0.05


def within_zones(points: DataFrame, zones: DataFrame, *, lat: str = "lat", lon: str = "lon",
                 cell_deg: float = ZONE_CELL_DEG) -> DataFrame:
    """(point, zone) rows where the zone polygon contains the point.

    Zones are keyed by the grid cells their bounding box covers and points by
    their cell, so the join is an equi-join on (cell, zone); edges
    are joined afterwards by zone, so a large zone's edges are not copied into its cells.
    """
    shapes = zone_edges(zones)
    edge_cols = ["outer_edges", "outer_points", "holes"]
    z = shapes.drop(*edge_cols, "rings")
    z = (z.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("min_lat") / cell_deg),
                                                  F.floor(F.col("max_lat") / cell_deg))))
         .withColumn("_cx", F.explode(F.sequence(F.floor(F.col("min_lon") / cell_deg),
                                                 F.floor(F.col("max_lon") / cell_deg)))))
    p = points.withColumn("_cy", F.floor(F.col(lat) / cell_deg)).withColumn("_cx", F.floor(F.col(lon) / cell_deg))
    j = p.join(z, ["_cy", "_cx"], "inner")
    j = j.filter((F.col(lat) >= F.col("min_lat")) & (F.col(lat) <= F.col("max_lat"))
              & (F.col(lon) >= F.col("min_lon")) & (F.col(lon) <= F.col("max_lon")))
    j = j.join(shapes.select("zone_ordinal", *edge_cols), "zone_ordinal")
    return j.filter(point_in_zone(F.col(lon), F.col(lat))).drop("_cy", "_cx", "outer_edges", "outer_points", "holes",
                                 "min_lon", "max_lon", "min_lat", "max_lat")


def best_zone(points: DataFrame, zones: DataFrame, key: list[str], *, lat: str = "lat", lon: str = "lon",
              zone_cols: list[str] | None = None) -> DataFrame:
    """First matching zone in file order per point, else nulls (J15): min_by over the zone ordinal."""
    zone_cols = zone_cols or ["zone_id", "zone_name", "zone_type"]
    hits = within_zones(points.select(*key, lat, lon), zones, lat=lat, lon=lon)
    best = (hits.groupBy(*key).agg(F.min_by(F.struct(*zone_cols), F.col("zone_ordinal")).alias("_z"))
            .select(*key, *[F.col("_z." + c).alias(c) for c in zone_cols]))
    return points.join(best, key, "left")


def _by_cell(points: DataFrame, boxes: DataFrame, lat: str, lon: str, cell_deg: float) -> tuple[DataFrame, Column]:
    """Boxes exploded to their grid cells with columns ``_b_*``, and the condition that pairs points with them."""
    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell_deg), F.floor(F.col(high) / cell_deg)))

    b = (boxes.withColumn("_by", span("lat_min", "lat_max")).withColumn("_bx", span("lon_min", "lon_max"))
         .withColumnsRenamed({c: "_b_" + c for c in boxes.columns}))
    cond = ((F.floor(F.col(lat) / cell_deg) == F.col("_by")) & (F.floor(F.col(lon) / cell_deg) == F.col("_bx"))
            & F.col(lat).between(F.col("_b_lat_min"), F.col("_b_lat_max"))
            & F.col(lon).between(F.col("_b_lon_min"), F.col("_b_lon_max")))
    return b, cond


def in_any_box(points: DataFrame, boxes: DataFrame, *, lat: str = "lat", lon: str = "lon",
               cell_deg: float = 1.0) -> DataFrame:
    """Keep points inside any (lat_min, lat_max, lon_min, lon_max) box (F7): a semi join keyed on grid cells."""
    b, cond = _by_cell(points, boxes, lat, lon, cell_deg)
    return points.join(b, cond, "left_semi")


def box_pairs(points: DataFrame, boxes: DataFrame, *, lat: str = "lat", lon: str = "lon", cell_deg: float = 1.0) -> DataFrame:
    """A row for each point and each box that holds it, with the box's other columns; an equi-join on grid cells."""
    b, cond = _by_cell(points, boxes, lat, lon, cell_deg)
    kept = [c for c in boxes.columns if c not in ("lat_min", "lat_max", "lon_min", "lon_max")]
    return points.join(b, cond).select(*points.columns, *[F.col("_b_" + c).alias(c) for c in kept])
