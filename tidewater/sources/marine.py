"""Weather and tide response bodies, one JSON text per port, to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAVES = {"wave_height": "wave_height_m", "wave_direction": "wave_direction_deg", "wave_period": "wave_period_s",
         "wind_wave_height": "wind_wave_height_m", "swell_wave_height": "swell_wave_height_m"}
WEATHER_BODY = "hourly STRUCT<time: ARRAY<STRING>, " + ", ".join(f"{k}: ARRAY<DOUBLE>" for k in WAVES) + ">"
TIDE_BODY = ("error STRUCT<message: STRING>, "
             "predictions ARRAY<STRUCT<t: STRING, v: STRING, type: STRING>>")


def unzip_weather(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per hour of the parallel arrays (N6): other columns, ``timestamp`` and the wave columns.

    A short or missing array gives null; values beyond the times, and bodies without times, give no row.
    """
    hourly = F.from_json(body_col, WEATHER_BODY)["hourly"]
    rest = [c for c in bodies.columns if c != body_col]
    zipped = F.arrays_zip(*[F.coalesce(hourly[k], F.array().cast("array<string>" if k == "time" else "array<double>")).alias(k)
                            for k in ["time", *WAVES]])
    # cut to the times, so that longer arrays add nothing
    hours = F.slice(zipped, 1, F.coalesce(F.size(hourly["time"]), F.lit(0)).cast("int"))
    rows = bodies.select(*rest, F.explode(F.when(F.size(hourly["time"]) > 0, hours)).alias("_h"))
    return rows.select(*rest, F.col("_h.time").alias("timestamp"), *[F.col(f"_h.{k}").alias(v) for k, v in WAVES.items()])


def parse_tides(bodies: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, rejected predictions, failed ports) of tide bodies.

    An event has a time ``yyyy-MM-dd HH:mm``, a numeric level (0 if missing) and type H or L.  A body with ``error`` is a
    failure of its port and gives no rows.
    """
    rest = [c for c in bodies.columns if c != body_col]
    b = bodies.withColumn("_b", F.from_json(body_col, TIDE_BODY))
    failed = b.filter("_b.error is not null").select(*rest, F.col("_b.error.message").alias("error"))
    p = b.filter("_b.error is null").select(*rest, F.explode("_b.predictions").alias("_p"))
    at = F.when(F.col("_p.t").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), F.try_to_timestamp("_p.t", F.lit("yyyy-MM-dd HH:mm")))
    level = F.coalesce(F.col("_p.v"), F.lit("0")).try_cast("double")
    good = F.coalesce(at.isNotNull() & level.isNotNull() & F.col("_p.type").isin("H", "L"), F.lit(False))
    events = p.filter(good).select(*rest, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                                   level.alias("tide_level_m"), F.col("_p.type").alias("tide_type"))
    return events, p.filter(~good).select(*rest, F.to_json("_p").alias("raw")), failed
