"""Incremental load of raw NDJSON files into typed tables.

A load lists the files below a prefix, takes those that its manifest does not hold, projects their keys to the table's columns
and writes rows, rejected lines and the manifest's new entries as one numbered version of the table's store; the commit comes
last.  A second load of the same files adds nothing, and a load that died anywhere is as if it had not been.

Layout below ``<target>/<table>``: ``data/load=<n>/rejected=<false|true>``, ``manifest/load=<n>``, ``commits``.
A full reload writes all files as new versions and hides the older ones by one commit, so readers go from the old table to
the new one at once.

The driver holds the paths of the files of one version only (``max_files``), as it does for any Spark read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewater.plans.staging import TABLE_COLUMNS
from tidewater.sources.store import Store

GLOB = "*.{ndjson,jsonl}"
MAX_FILES = 100_000
MANIFEST = "file string, bytes long, row_count long, rejected_lines long, loaded_at timestamp"

# --- Fixed values: column types of the five raw tables (text unless stated), and columns that a row must have ---
TABLE_TYPES: dict[str, dict[str, str]] = {
    "raw_ais_positions": {"mmsi": "bigint", "latitude": "double", "longitude": "double", "speed_knots": "double",
                          "course_deg": "double", "heading_deg": "double", "timestamp": "timestamp"},
    "raw_comtrade_flows": {"primary_value": "double", "net_wgt": "double"},
    "raw_weather_observations": {"observation_hour": "timestamp", "wave_height_m": "double", "wave_period_s": "double",
                                 "wave_direction_deg": "double"},
    "raw_gdelt_events": {"event_date": "date", "lat": "double", "lon": "double"},
    "raw_fred_indicators": {"observation_date": "date", "value": "double"},
}
REQUIRED: dict[str, list[str]] = {
    "raw_ais_positions": ["mmsi", "timestamp"],
    "raw_comtrade_flows": [],
    "raw_weather_observations": ["port_code", "observation_hour"],
    "raw_gdelt_events": ["event_id", "event_date"],
    "raw_fred_indicators": ["series_id", "observation_date"],
}
# --- Fixed values: keys that may hold a record's arrival time, in order ---
TIME_KEYS = ["received_at", "timestamp", "time_utc"]


@dataclass(frozen=True)
class LoadResult:
    files: int
    rows: int
    rejected: int


def list_files(spark: SparkSession, prefix: str, glob: str = GLOB) -> DataFrame:
    """file, modified, bytes of the data files below a prefix, at any depth (S10).  No file is opened; one without content is not listed."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(prefix))
    return listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def outside_first_minutes(record: Column, minutes: int) -> Column:
    """The record's arrival minute is ``minutes`` or later.

    The time is the first of ``TIME_KEYS`` that is neither null nor empty; a record without a usable one is never outside.
    """
    text = F.coalesce(*[F.nullif(record[k], F.lit("")) for k in TIME_KEYS])
    minute = F.substring(text, 15, 2)
    usable = (F.length(text) >= 16) & minute.rlike("^[0-9]{2}$") & ~text.rlike("^[0-9.]+$")
    return F.coalesce(usable & (minute.try_cast("int") >= minutes), F.lit(False))


def mapped_lines(lines: DataFrame, table: str, sample_minutes: int = 0) -> DataFrame:
    """Lines (``file``, ``value``) -> the table's typed columns, ``file``, ``rejected``, ``line`` and ``reason``.

    Blank lines are passed over.  A line that is no JSON object, or lacks a required column, is rejected with its text.
    Blank and null values are null, so is a value that doesn't cast.
    """
    keys = list(dict.fromkeys([*(k for k, _ in TABLE_COLUMNS[table]), *TIME_KEYS]))
    schema = "array<struct<" + ", ".join(f"`{k}`: string" for k in keys) + ">>"
    value = F.trim("value")
    # as a list of one: what stands behind the object makes the list longer, or no list at all
    d = lines.filter(value != "").withColumn("_l", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), schema))
    d = d.withColumn("_r", F.when(F.size("_l") == 1, F.get("_l", F.lit(0))))
    r = F.col("_r")
    whole = value.startswith("{") & r.isNotNull()
    if sample_minutes > 0:
        d = d.filter(~(F.coalesce(whole, F.lit(False)) & outside_first_minutes(r, sample_minutes)))
    types = TABLE_TYPES[table]
    typed = {}
    for key, column in TABLE_COLUMNS[table]:
        text = F.nullif(r[key], F.lit(""))
        kind = types.get(column, "string")
        typed[column] = F.try_to_timestamp(text) if kind == "timestamp" else text.try_cast(kind)
    lacks = F.concat_ws(",", *[F.when(typed[c].isNull(), c) for c in REQUIRED[table]], F.lit(None).cast("string"))
    reason = F.when(~F.coalesce(whole, F.lit(False)), "no json object").when(lacks != "", F.concat(F.lit("no "), lacks))
    d = d.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return d.select(*[F.when(good, c).alias(name) for name, c in typed.items()], "file", (~good).alias("rejected"),
                    F.when(~good, F.col("value")).alias("line"), "reason")


def store(spark: SparkSession, target: str, table: str) -> Store:
    return Store(spark, f"{target.rstrip('/')}/{table}")


def data_schema(table: str) -> str:
    types = TABLE_TYPES[table]
    return ", ".join(f"`{c}` {types.get(c, 'string')}" for _, c in TABLE_COLUMNS[table]) + \
        ", file string, line string, reason string, rejected boolean"


def manifest(spark: SparkSession, target: str, table: str) -> DataFrame:
    """One row per loaded file: the newest load's size, counts and time."""
    rows = store(spark, target, table).visible("manifest", MANIFEST)
    names = ["bytes", "row_count", "rejected_lines", "loaded_at", "load"]
    return rows.groupBy("file").agg(F.max_by(F.struct(*names), "load").alias("m")).select("file", "m.*")


def read_table(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The table's rows, with the number of the load that brought each."""
    rows = store(spark, target, table).visible("data", data_schema(table)).filter(~F.col("rejected"))
    return rows.select(*[c for _, c in TABLE_COLUMNS[table]], "load")


def read_rejects(spark: SparkSession, target: str, table: str) -> DataFrame:
    """Rejected lines with the reason and the load."""
    return store(spark, target, table).visible("data", data_schema(table)).filter("rejected").select("file", "line", "reason", "load")


def _write_version(s: Store, table: str, number: int, files: list[tuple[str, int]], sample_minutes: int) -> LoadResult:
    """Rows and manifest of some files as version ``number``; one pass over the files."""
    spark = s.spark
    lines = spark.read.text([f for f, _ in files]).select(F.col("_metadata.file_path").alias("file"), "value")
    counts = Observation()
    rows = mapped_lines(lines, table, sample_minutes).observe(
        counts, F.count_if(~F.col("rejected")).alias("rows"), F.count_if("rejected").alias("rejected"))
    rows.write.mode("overwrite").partitionBy("rejected").parquet(s.path("data", f"load={number}"))
    listed = spark.createDataFrame(files, "file string, bytes long")
    written = spark.read.schema(data_schema(table)).parquet(s.path("data", f"load={number}"))
    per_file = written.groupBy("file").agg(F.count_if(~F.col("rejected")).alias("row_count"), F.count_if("rejected").alias("rejected_lines"))
    (listed.join(per_file, "file", "left")
     .select("file", "bytes", F.coalesce("row_count", F.lit(0)).alias("row_count"),
             F.coalesce("rejected_lines", F.lit(0)).alias("rejected_lines"), F.current_timestamp().alias("loaded_at"))
     .write.mode("overwrite").parquet(s.path("manifest", f"load={number}")))
    return LoadResult(len(files), int(counts.get["rows"]), int(counts.get["rejected"]))


def load_files(spark: SparkSession, prefix: str, target: str, table: str, *, sample_minutes: int = 0,
               reload_existing: bool = False, truncate: bool = False, glob: str = GLOB, max_files: int = MAX_FILES) -> LoadResult:
    """Load the files below ``prefix`` that the table has not loaded yet.

    ``reload_existing``: load all of them again, on top of what is there; no file at all is then an error.
    ``truncate``: empty table and manifest, and load all (S9); all versions of a reload count from one commit on.
    """
    s = store(spark, target, table)
    found = list_files(spark, prefix, glob).select("file", "bytes")
    if not (reload_existing or truncate):
        found = found.join(manifest(spark, target, table).select("file"), "file", "left_anti")
    files = [(r["file"], r["bytes"]) for r in found.orderBy("file").collect()]
    if not files and reload_existing:
        raise FileNotFoundError(f"no files below {prefix}")
    first = number = s.next_number()
    parts = [files[i:i + max_files] for i in range(0, len(files), max_files)]
    done: list[LoadResult] = []
    for part in parts:
        done.append(_write_version(s, table, number, part, sample_minutes))
        if not truncate:
            s.commit(number, number, False, done[-1].rows, len(part))
        number += 1
    total = LoadResult(len(files), sum(r.rows for r in done), sum(r.rejected for r in done))
    if truncate:
        s.commit(max(first, number - 1), first, True, total.rows, total.files)
    return total
