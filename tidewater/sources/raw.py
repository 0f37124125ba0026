"""Raw NDJSON sources and sinks, AIS message flattening.

Raw files are newline-delimited JSON below ``root/source=<s>/date=<d>/``; the
``date`` partition column is discovered from the path, so lookback filters
prune partitions.  Message flattening runs on VARIANT values
(``try_parse_json`` + ``try_variant_get``): no Python per record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater import refdata as R

POSITION_SCHEMA = ("mmsi BIGINT, ship_name STRING, lat DOUBLE, lon DOUBLE, sog DOUBLE, cog DOUBLE, "
                   "true_heading INT, nav_status INT, msg_type STRING, received_at STRING")
# --- Fixed values: columns of the five raw sources, by their folder names (S1) ---
RAW_SCHEMAS = {
    "ais": POSITION_SCHEMA,
    "ais_voyage": ("mmsi BIGINT, ship_name STRING, call_sign STRING, imo_number STRING, ship_type STRING, destination STRING, "
                   "eta_raw STRING, eta_timestamp_utc STRING, draught_m DOUBLE, dimension_to_bow_m INT, dimension_to_stern_m INT, "
                   "dimension_to_port_m INT, dimension_to_starboard_m INT, msg_type STRING, received_at STRING"),
    "weather": ("port_code STRING, timestamp STRING, wave_height_m DOUBLE, wave_direction_deg DOUBLE, wave_period_s DOUBLE, "
                "wind_wave_height_m DOUBLE, swell_wave_height_m DOUBLE"),
    "noaa_tides": "port_code STRING, station_id STRING, timestamp STRING, tide_level_m DOUBLE, tide_type STRING",
    "gdelt_events": ("event_id STRING, source STRING, query_name STRING, query STRING, fetched_at STRING, seen_at STRING, "
                     "title STRING, url STRING, domain STRING, language STRING, source_country STRING, port_code STRING, "
                     "port_name STRING, attribution_reason STRING, event_category STRING, severity_score DOUBLE, "
                     "matched_terms ARRAY<STRING>"),
}
CORRUPT = "_corrupt_record"


def source_path(root: str, source: str) -> str:
    """The folder of a source; a record's own ``source`` field is another thing and stays in the file."""
    return f"{root.rstrip('/')}/source={source}"


def sink_ndjson(records: DataFrame, root: str, source: str, date_col: str = "date") -> None:
    """Append records under source=<s>/date=<d> (S3); an empty batch is an error."""
    if records.isEmpty():
        raise ValueError("refusing to write an empty batch")
    records.write.mode("append").partitionBy(date_col).json(source_path(root, source))


def sink_counted(records: DataFrame, root: str, source: str, counts: dict[str, Column], date_col: str = "date") -> dict[str, int]:
    """As ``sink_ndjson``, and the run's counts (A23): measured while the rows are written, without a second pass.

    ``records`` counts all rows, ``counts`` the rows that meet a condition; ``files`` are those that the run wrote.  A run of
    no records writes none and is an error.
    """
    seen, token = Observation(), uuid.uuid4().hex[:12]
    measured = [F.count_if(c).alias(name) for name, c in counts.items()]
    (records.observe(seen, F.count(F.lit(1)).alias("records"), *measured).withColumn("run", F.lit(token))
     .write.mode("append").partitionBy(date_col, "run").json(source_path(root, source)))
    out = {k: int(v) for k, v in seen.get.items()}
    if not out["records"]:
        raise ValueError("a run without records")
    files = (records.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
             .load(source_path(root, source)).filter(F.col("path").contains(f"/run={token}/")))
    return {**out, "files": files.select("path").count()}


def scan_raw_json(spark: SparkSession, root: str, source: str, schema: str | None = None,
                  glob: str = "*.{json,ndjson,jsonl}", quarantine: bool = False) -> DataFrame:
    """Read one raw source with a fixed schema and its date partition.

    ``quarantine``: keep unparseable lines in ``_corrupt_record`` (S7) instead
    of dropping them; blank lines are skipped by the reader.  The schema is that of the source unless given.
    """
    schema = schema or RAW_SCHEMAS[source]
    full = f"{schema}, {CORRUPT} STRING, date STRING" if quarantine else f"{schema}, date STRING"
    reader = (spark.read.schema(full).option("pathGlobFilter", glob)
              .option("mode", "PERMISSIVE"))
    if quarantine:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(source_path(root, source))


# --- AIS envelope flattening (N1, N3) -------------------------------------------------

def _vget(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def _payload(v: Column, names: list[str]) -> Column:
    """The message's first payload object under one of the names, else the message itself."""
    found = [_vget(v, f"$.Message.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(F.schema_of_variant(p).startswith("OBJECT"), p) for p in found],
                      _vget(v, "$.Message", "variant"))


def _field(p: Column, keys: list[str], typ: str) -> Column:
    """Value of the first key that is neither null nor empty (N4); null if that value doesn't cast."""
    out = None
    for k in keys:
        text = _vget(p, f"$.{k}", "string")
        out = (F if out is None else out).when(text != "", _vget(p, f"$.{k}", typ))
    return out


POSITION_TYPES = R.POSITION_MESSAGE_TYPES + ["1", "2", "3", "18"]
VOYAGE_TYPES = R.VOYAGE_MESSAGE_TYPES + ["5"]


def _position_fields(v: Column, p: Column, mtype: Column, received: Column) -> list[Column]:
    """Flat columns of a position message ``v`` with the payload ``p``."""
    return [
        _vget(v, "$.MetaData.MMSI", "bigint").alias("mmsi"),
        F.trim(F.coalesce(_vget(v, "$.MetaData.ShipName", "string"), F.lit(""))).alias("ship_name"),
        F.coalesce(_field(p, ["Latitude"], "double"), _vget(v, "$.MetaData.latitude", "double"), F.lit(0.0)).alias("lat"),
        F.coalesce(_field(p, ["Longitude"], "double"), _vget(v, "$.MetaData.longitude", "double"), F.lit(0.0)).alias("lon"),
        F.coalesce(_field(p, ["Sog", "SpeedOverGround"], "double"), F.lit(0.0)).alias("sog"),
        F.coalesce(_field(p, ["Cog", "CourseOverGround"], "double"), F.lit(0.0)).alias("cog"),
        F.coalesce(_field(p, ["TrueHeading"], "int"), F.lit(511)).alias("true_heading"),
        F.coalesce(_field(p, ["NavigationalStatus", "NavigationStatus"], "int"), F.lit(15)).alias("nav_status"),
        mtype.alias("msg_type"), received.alias("received_at")]


def flatten_positions(messages: DataFrame, text_col: str = "value", received_col: str = "received_at") -> DataFrame:
    """AIS envelope text -> flat position rows (N1); non-position types are dropped.

    All fields come from one payload, that under its type name, else the message itself; payload lat/lon else
    metadata lat/lon; defaults sog 0, cog 0, heading 511, nav 15; trimmed name.
    """
    v, p = F.col("_v"), F.col("_p")
    m = messages.withColumn("_v", F.try_parse_json(F.col(text_col)))
    mtype = _vget(v, "$.MessageType", "string")
    m = m.filter(mtype.isin(POSITION_TYPES) & _vget(v, "$.MetaData.MMSI", "bigint").isNotNull()) \
        .withColumn("_p", _payload(v, R.POSITION_MESSAGE_TYPES))
    return m.select(*_position_fields(v, p, mtype, F.col(received_col)))


def infer_eta(eta: Column, received: Column) -> Column:
    """ETA variant -> timestamp (N5): ISO text as it is; month/day/hour/minute at its next turn from ``received``."""
    part = {k: _field(eta, [k, k.lower()], "int") for k in ("Month", "Day", "Hour", "Minute")}
    month, day = part["Month"], part["Day"]
    hour, minute = F.coalesce(part["Hour"], F.lit(0)), F.coalesce(part["Minute"], F.lit(0))

    def turn(year: Column) -> Column:
        return F.when(hour.between(0, 23) & minute.between(0, 59),
                      F.try_make_timestamp(year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)")))

    now = turn(F.year(received))
    return (F.when(F.schema_of_variant(eta) == "STRING", F.try_to_timestamp(F.trim(eta.cast("string"))))
            .when(F.schema_of_variant(eta).startswith("OBJECT"),
                  F.when(now >= received, now).when(now < received, turn(F.year(received) + 1))))


def _voyage_fields(v: Column, p: Column, eta: Column, mtype: Column, received: Column) -> list[Column]:
    """The 15 columns of a voyage message ``v`` with the payload ``p`` and its ETA value."""
    def text(*keys: str) -> Column:
        return F.trim(_field(p, list(keys), "string"))

    sides = {"bow": "A", "stern": "B", "port": "C", "starboard": "D"}
    return [
        _vget(v, "$.MetaData.MMSI", "bigint").alias("mmsi"),
        F.coalesce(text("Name", "ShipName"), F.trim(_vget(v, "$.MetaData.ShipName", "string")), F.lit("")).alias("ship_name"),
        text("CallSign", "Callsign").alias("call_sign"),
        text("ImoNumber", "IMONumber", "IMO").alias("imo_number"),
        text("Type", "ShipType").alias("ship_type"),
        text("Destination").alias("destination"),
        eta.cast("string").alias("eta_raw"),
        F.date_format(infer_eta(eta, received.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("eta_timestamp_utc"),
        _field(p, ["MaximumStaticDraught", "MaximumDraught", "Draught"], "double").alias("draught_m"),
        *[F.coalesce(_field(p, [f"DimensionTo{s.capitalize()}"], "int"), _field(p, [f"Dimension.{k}"], "int"))
          .alias(f"dimension_to_{s}_m") for s, k in sides.items()],
        mtype.alias("msg_type"), received.alias("received_at")]


_ETA = ["Eta", "ETA", "EstimatedTimeOfArrival"]


def flatten_voyages(messages: DataFrame, text_col: str = "value", received_col: str = "received_at") -> DataFrame:
    """AIS envelope text -> the 15 voyage columns (N2); other types are dropped.

    ``eta_raw`` keeps an ETA object as compact JSON text.  An empty or uncastable field is null.
    """
    v, p, eta = F.col("_v"), F.col("_p"), F.col("_eta")
    m = messages.withColumn("_v", F.try_parse_json(F.col(text_col)))
    mtype = _vget(v, "$.MessageType", "string")
    m = m.filter(mtype.isin(VOYAGE_TYPES) & _vget(v, "$.MetaData.MMSI", "bigint").isNotNull())
    m = m.withColumn("_p", _payload(v, R.VOYAGE_MESSAGE_TYPES)).withColumn("_eta", _field(p, _ETA, "variant"))
    return m.select(*_voyage_fields(v, p, eta, mtype, F.col(received_col)))


def sorted_messages(messages: DataFrame, text_col: str = "value", received_col: str = "received_at") -> DataFrame:
    """Every message with the sink it belongs to, parsed once.

    ``sink``: ``positions`` or ``voyage`` (their columns are the struct of that name), ``other`` (a message of another type),
    ``quarantine`` (no JSON, no message type, or a position or voyage without a vessel number; ``value`` keeps the line).
    """
    v, p, eta, received = F.col("_v"), F.col("_p"), F.col("_eta"), F.col(received_col)
    m = messages.withColumn("_v", F.try_parse_json(F.col(text_col)))
    mtype = _vget(v, "$.MessageType", "string")
    is_pos, is_voy = mtype.isin(POSITION_TYPES), mtype.isin(VOYAGE_TYPES)
    bad = v.isNull() | mtype.isNull() | ((is_pos | is_voy) & _vget(v, "$.MetaData.MMSI", "bigint").isNull())
    m = m.withColumn("sink", F.when(bad, "quarantine").when(is_pos, "positions").when(is_voy, "voyage").otherwise("other"))
    sink = F.col("sink")
    m = m.withColumn("_p", F.when(sink == "positions", _payload(v, R.POSITION_MESSAGE_TYPES)).when(sink == "voyage", _payload(v, R.VOYAGE_MESSAGE_TYPES)))
    m = m.withColumn("_eta", F.when(sink == "voyage", _field(p, _ETA, "variant")))
    return m.select("sink", F.when(sink == "positions", F.struct(*_position_fields(v, p, mtype, received))).alias("position"),
                    F.when(sink == "voyage", F.struct(*_voyage_fields(v, p, eta, mtype, received))).alias("voyage"),
                    F.when(sink == "quarantine", F.col(text_col)).alias("value"), F.substring(received, 1, 10).alias("date"))


def envelopes_from_positions(positions: DataFrame) -> DataFrame:
    """AIS envelope JSON text built from derived positions (three payload shapes by event_id % 3)."""
    e = F.col("event_id") % 3
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.concat(F.lit("  "), F.col("ship_name"), F.lit(" ")).alias("ShipName"),
                    F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    full = F.struct(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.col("sog").alias("Sog"),
                    F.col("cog").alias("Cog"), F.col("true_heading").alias("TrueHeading"),
                    F.col("nav_status").alias("NavigationalStatus"))
    class_b = F.struct(F.col("sog").alias("SpeedOverGround"), F.col("cog").alias("CourseOverGround"),
                       F.col("nav_status").alias("NavigationStatus"))
    msg0 = F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"),
                              F.struct(full.alias("PositionReport")).alias("Message")))
    msg1 = F.to_json(F.struct(F.lit("StandardClassBPositionReport").alias("MessageType"), meta.alias("MetaData"),
                              F.struct(class_b.alias("StandardClassBPositionReport")).alias("Message")))
    msg2 = F.to_json(F.struct(F.lit("ShipStaticData").alias("MessageType"), meta.alias("MetaData"),
                              F.struct(F.struct(F.lit("X").alias("Name")).alias("ShipStaticData")).alias("Message")))
    text = F.when(e == 0, msg0).when(e == 1, msg1).otherwise(msg2)
    return positions.select("event_id", text.alias("value"),
                            F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("received_at"),
                            "date")


def envelopes_from_voyages(positions: DataFrame) -> DataFrame:
    """AIS static messages as JSON text from derived positions (four payload shapes by event_id % 4)."""
    e = F.col("event_id").cast("int")
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.concat(F.lit(" "), F.col("ship_name"), F.lit(" ")).alias("ShipName"))
    eta = F.struct((1 + e % 12).alias("Month"), (1 + e % 31).alias("Day"), (e % 25).alias("Hour"), (e % 60).alias("Minute"))
    full = F.struct(F.concat(F.lit("V"), e, F.lit("  ")).alias("Name"), F.concat(F.lit("C"), e).alias("CallSign"),
                    e.alias("ImoNumber"), (e % 90).alias("Type"), F.lit("USLAX").alias("Destination"), eta.alias("Eta"),
                    ((e % 150) / 10).alias("MaximumStaticDraught"),
                    F.struct((e % 300).alias("A"), (e % 50).alias("B"), (e % 20).alias("C")).alias("Dimension"))
    mixed = F.struct(F.lit("").alias("Name"), F.concat(F.lit("S"), e).alias("ShipName"), F.lit("bad").alias("MaximumDraught"),
                     F.lit(7.5).alias("Draught"), (e % 400).alias("DimensionToBow"), F.struct(F.lit(1).alias("A")).alias("Dimension"),
                     F.lit("2031-02-03T04:05:06Z").alias("ETA"))
    bare = F.struct(F.concat(F.lit("B"), e).alias("Callsign"), F.lit("").alias("Destination"))

    def message(kind: str, body: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("MessageType"), meta.alias("MetaData"), body.alias("Message")))

    text = (F.when(e % 4 == 0, message("ShipStaticData", F.struct(full.alias("ShipStaticData"), F.lit("X").alias("Callsign"))))
            .when(e % 4 == 1, message("VoyageData", F.struct(mixed.alias("VoyageData"))))
            .when(e % 4 == 2, message("5", bare))
            .otherwise(message("PositionReport", bare)))
    return positions.select("event_id", text.alias("value"),
                            F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("received_at"), "date")
