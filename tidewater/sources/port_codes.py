"""Port code list (headerless CSV), capture boxes and port centres.

Rows keep an order across files and file splits: (file, first byte of the split, place in the split).  "The last row of a code
wins" is then a grouped maximum, without a sort of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.functions.rules import py_round

# --- Fixed values: columns of the code list, in order ---
COLUMNS = ["Chg", "Country", "Location", "Name", "NameWoDiacritics", "SubDiv", "Function", "Status", "Date", "IATA", "Coordinates", "Remarks"]
#: Function character of a sea port, and the least cosine that widens a box.
SEA_PORT = "1"
LEAST_COS = 0.1


def scan_locode_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 12 text columns and ``row_order`` of a code list (S14); a byte order mark is dropped, an empty field is an empty text."""
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    rows = spark.read.schema(schema).option("header", False).option("encoding", "UTF-8").option("escape", '"').csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                     F.monotonically_increasing_id().alias("place"))
    texts = [F.coalesce(F.regexp_replace(c, "^﻿", "") if c == COLUMNS[0] else F.col(c), F.lit("")).alias(c) for c in COLUMNS]
    return rows.select(*texts, order.alias("row_order"))


def _degrees(text: Column, whole: int) -> Column:
    """``DDMM`` or ``DDDMM`` with a letter behind it -> degrees; null unless both parts are digits."""
    deg, minute = F.substring(text, 1, whole), F.substring(text, whole + 1, 2)
    digits = deg.rlike("^[0-9]+$") & minute.rlike("^[0-9]+$")
    value = deg.try_cast("double") + minute.try_cast("double") / 60.0
    return F.when(digits, F.when(F.upper(F.substring(text, -1, 1)).isin("S", "W"), -value).otherwise(value))


def parse_locodes(rows: DataFrame) -> DataFrame:
    """country, location, locode, lat, lon, row_order of the sea ports with usable coordinates; the others are passed over."""
    parts = F.split(F.regexp_replace(F.btrim("Coordinates", F.lit(" \t\n\r\f\x0b")), r"\s+", " "), " ")
    lat_text, lon_text = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    # only a latitude turns at S, only a longitude at W
    lat = F.when(F.upper(F.substring(lat_text, -1, 1)) == "W", F.abs(_degrees(lat_text, 2))).otherwise(_degrees(lat_text, 2))
    lon = F.when(F.upper(F.substring(lon_text, -1, 1)) == "S", F.abs(_degrees(lon_text, 3))).otherwise(_degrees(lon_text, 3))
    country, location = F.trim("Country"), F.trim("Location")
    return (rows.filter(F.col("Function").contains(SEA_PORT) & (F.size(parts) == 2))
            .select(country.alias("country"), location.alias("location"), F.concat(country, location).alias("locode"),
                    lat.alias("lat"), lon.alias("lon"), "row_order")
            .filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()))


def capture_boxes(ports: DataFrame, half_width_nm: float = R.CAPTURE_BOX_HALF_WIDTH_NM) -> DataFrame:
    """A box around each row's ``lat`` and ``lon``: +- the half width, in longitude over the cosine; 4 decimals."""
    d_lat = half_width_nm / 60.0
    d_lon = F.lit(half_width_nm * (1 / 60)) / F.greatest(F.cos(F.radians("lat")), F.lit(LEAST_COS))
    kept = [c for c in ports.columns if c not in ("lat", "lon")]
    return ports.select(*kept, py_round(F.col("lat") - d_lat, 4).alias("lat_min"), py_round(F.col("lat") + d_lat, 4).alias("lat_max"),
                        py_round(F.col("lon") - d_lon, 4).alias("lon_min"), py_round(F.col("lon") + d_lon, 4).alias("lon_max"))


def port_boxes(rows: DataFrame, include: list[str] | None = None) -> DataFrame:
    """One box per usable row of the code list, of the given codes only if there are any."""
    ports = parse_locodes(rows)
    if include is not None:
        ports = ports.filter(F.col("locode").isin(include))
    return capture_boxes(ports.select("locode", "lat", "lon"))


def port_centres(rows: DataFrame) -> DataFrame:
    """One centre per code, its last usable row's, 4 decimals; rows without a country or location are passed over."""
    ports = parse_locodes(rows).filter((F.col("country") != "") & (F.col("location") != ""))
    last = ports.groupBy("locode").agg(F.max_by(F.struct("lat", "lon"), "row_order").alias("c"))
    return last.select("locode", py_round(F.col("c.lat"), 4).alias("lat"), py_round(F.col("c.lon"), 4).alias("lon"))
