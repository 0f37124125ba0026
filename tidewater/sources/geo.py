"""Polygon zone sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")
USLAX_ANCHORAGES = os.path.join(RESOURCES, "uslax_anchorages.geojson")


def scan_geojson(spark: SparkSession, path: str = USLAX_ANCHORAGES) -> DataFrame:
    """Feature collection -> one row per Polygon feature with its rings and file ordinal.

    Fails (raise_error) when the document is not a FeatureCollection.
    """
    doc = spark.read.option("multiLine", "true").option("primitivesAsString", "false").json(path)
    checked = doc.select(
        F.when(F.col("type") == "FeatureCollection", F.col("features"))
        .otherwise(F.raise_error(F.lit("Expected a GeoJSON FeatureCollection"))).alias("features"))
    feats = checked.select(F.posexplode("features").alias("zone_ordinal", "f"))
    return (feats.filter(F.col("f.geometry.type") == "Polygon")
            .select("zone_ordinal",
                    F.col("f.properties.port_code").alias("port_code"),
                    F.col("f.properties.zone_id").alias("zone_id"),
                    F.col("f.properties.zone_name").alias("zone_name"),
                    F.col("f.properties.zone_type").alias("zone_type"),
                    F.col("f.properties.confidence").alias("confidence"),
                    F.col("f.geometry.coordinates").cast("array<array<array<double>>>").alias("rings")))


def zone_edge_rows() -> list[tuple]:
    """(zone_ordinal, zone_id, x1, y1, x2, y2) edges in Python, for the SQL oracle."""
    import json
    with open(USLAX_ANCHORAGES, encoding="utf-8") as fh:
        doc = json.load(fh)
    out = []
    for i, f in enumerate(doc["features"]):
        ring = f["geometry"]["coordinates"][0]
        for k in range(len(ring)):
            (x1, y1), (x2, y2) = ring[k - 1], ring[k]
            out.append((i, f["properties"]["zone_id"], x1, y1, x2, y2))
    return out
