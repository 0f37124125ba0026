"""Live vessels around ports: the newest record of each vessel in a port's box, gone after minutes of silence.

State is one record per (port, vessel) in RocksDB, with an event-time timer.  A record that is newer than the one held
replaces it and moves the timer; an older one changes nothing.  A timer that the watermark has passed clears the state.
The stream's output is a log of changes, written per micro-batch (a replayed batch replaces its own folder); the live table
is the newest change of each key that is not a removal.

Executors hold the state of their own keys; a port's vessels spread over all partitions, as the key holds the vessel.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater import refdata as R
from tidewater.functions import rules
from tidewater.functions.geo import equirect_nm
from tidewater.functions.timefn import parse_iso
from tidewater.operators.spatial import box_pairs
from tidewater.sources.raw import flatten_positions
from tidewater.streaming.capture import LINE_SCHEMA

TTL_MINUTES = 5
RECORD = "name string, lat double, lon double, sog double, cog double, zone string, dist double, seen_us long"
CHANGE = f"port_code string, mmsi long, {RECORD}, gone boolean"
_FIELDS = [f.split()[0] for f in RECORD.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def port_boxes(ports: DataFrame, delta: float = R.LIVE_BOX_DELTA_DEG) -> DataFrame:
    """A box of +-``delta`` degrees around each port, with the port's code and centre."""
    return ports.select("port_code", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon"),
                        (F.col("lat") - delta).alias("lat_min"), (F.col("lat") + delta).alias("lat_max"),
                        (F.col("lon") - delta).alias("lon_min"), (F.col("lon") + delta).alias("lon_max"))


def live_records(lines: DataFrame, ports: DataFrame) -> DataFrame:
    """Position reports inside a port's box, as the map shows them; ``seen`` is their arrival."""
    flat = flatten_positions(lines).filter(F.col("msg_type") == "PositionReport")
    near = box_pairs(flat, port_boxes(ports))
    dist = equirect_nm("lat", "lon", "port_lat", "port_lon")
    seen = parse_iso(F.col("received_at")).cast("timestamp")
    return near.select("port_code", "mmsi", rules.name_fallback("ship_name", "mmsi").alias("name"), "lat", "lon",
                       F.round("sog", 1).alias("sog"), F.round("cog", 0).alias("cog"), rules.live_zone(dist, F.col("sog")).alias("zone"),
                       F.round(dist, 1).alias("dist"), F.unix_micros(seen).alias("seen_us"), seen.alias("seen"))


class _Latest(StatefulProcessor):
    """Newest record of a key; ties go to the greater record."""

    def __init__(self, ttl_minutes: int):
        self.ttl_us = ttl_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)

    def _change(self, key, record, gone: bool):
        import pandas as pd
        return pd.DataFrame([(*key, *record, gone)], columns=["port_code", "mmsi", *_FIELDS, "gone"])

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        best = None
        for part in rows:
            for r in part[_FIELDS].itertuples(index=False, name=None):
                if best is None or (r[-1], r) > (best[-1], best):
                    best = r
        held = self.record.get() if self.record.exists() else None
        if best is None or (held is not None and (held[-1], tuple(held)) >= (best[-1], best)):
            return
        best = tuple(x.item() if hasattr(x, "item") else x for x in best)
        self.record.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        # the first millisecond at which the last record is older than the limit
        self.handle.registerTimer((best[-1] + self.ttl_us) // 1000 + 1)
        yield self._change(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.record.exists():
            last = self.record.get()
            self.record.clear()
            yield self._change(key, last, True)

    def close(self) -> None:
        pass


def run_live(spark: SparkSession, source_dir: str, ports: DataFrame, out_root: str, checkpoint: str, *, ttl_minutes: int = TTL_MINUTES,
             delay: str = "0 seconds", max_files: int | None = None, processing_time: str | None = None, timeout_s: float | None = None) -> None:
    """Message lines -> the log of changes below ``out_root``.  ``delay``: how late messages may come (the watermark's)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(LINE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    records = live_records(reader.json(source_dir), ports).withWatermark("seen", delay)
    changes = records.groupBy("port_code", "mmsi").transformWithStateInPandas(
        statefulProcessor=_Latest(ttl_minutes), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_root}/batch_id={epoch}")

    writer = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if processing_time is None else writer.trigger(processingTime=processing_time)).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()


def live_vessels(spark: SparkSession, out_root: str) -> DataFrame:
    """The live table: the newest change of each (port, vessel), removals left out."""
    log = spark.read.parquet(out_root)
    newest = log.groupBy("port_code", "mmsi").agg(
        F.max_by(F.struct(*_FIELDS, "gone"), F.struct("batch_id", "seen_us", "gone")).alias("c")).select("port_code", "mmsi", "c.*")
    return newest.filter(~F.col("gone")).select(
        "port_code", "mmsi", "name", "lat", "lon", "sog", "cog", "zone", "dist", F.lit(100).alias("conf"), F.lit("--:--").alias("eta"),
        F.timestamp_micros("seen_us").cast("timestamp_ntz").alias("last_seen"))
