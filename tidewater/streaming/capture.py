"""Structured Streaming capture of raw messages.

The reference captures a socket feed for a fixed budget and flushes every 60 s.  Here a file (or Kafka) source of raw message
lines is one stream: a micro-batch is parsed once and written once, as positions, voyages and rejected lines (partitions of
one folder).  A batch overwrites its own ``batch_id`` folder, so a replayed batch replaces itself; duplicates of
(mmsi, received_at) across batches go when the sink is read.  No watermark stands before the sinks: late rows stay.
Checkpoints lie in the shared checkpoint folder, so a lost executor or a restarted driver resumes without loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.timefn import parse_iso
from tidewater.sources.raw import sorted_messages

LINE_SCHEMA = "event_id BIGINT, value STRING, received_at STRING, date STRING"
SINKS = ["positions", "voyage", "quarantine"]


def write_batch(batch: DataFrame, epoch: int, out_root: str) -> dict[str, int]:
    """One micro-batch into its three sinks, in one pass; its counts, measured on the way and kept beside them."""
    seen, sink = Observation(), F.col("sink")
    rows = sorted_messages(batch).observe(seen, F.count_if(sink != "quarantine").alias("received"),
                                          *[F.count_if(sink == s).alias(s) for s in [*SINKS, "other"]])
    rows.filter(sink != "other").write.mode("overwrite").partitionBy("sink", "date").parquet(f"{out_root}/messages/batch_id={epoch}")
    counts = {k: int(v) for k, v in seen.get.items()}
    spark = batch.sparkSession
    spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)).coalesce(1) \
        .write.mode("overwrite").parquet(f"{out_root}/counts/batch_id={epoch}")
    return counts


def run_capture(spark: SparkSession, source_dir: str, out_root: str, checkpoint: str, *,
                processing_time: str | None = None, timeout_s: float | None = None, max_files: int | None = None):
    """Raw message lines -> positions, voyage and quarantine sinks.

    ``processing_time=None`` runs ``availableNow`` (bounded run: process what is there, then stop - R2); otherwise a fixed
    flush trigger such as "60 seconds" (R1) until ``timeout_s``.  ``max_files``: of a micro-batch.
    """
    reader = spark.readStream.schema(LINE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def put(batch: DataFrame, epoch: int) -> None:
        write_batch(batch, epoch, out_root)

    writer = reader.json(source_dir).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if processing_time is None else writer.trigger(processingTime=processing_time)).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
    return query


def read_sink(spark: SparkSession, out_root: str, sink: str) -> DataFrame:
    """Rows of one sink with ``date``: positions and voyages one per (mmsi, received_at), rejected lines as they came."""
    rows = spark.read.parquet(f"{out_root}/messages").filter(F.col("sink") == sink).withColumn("date", F.col("date").cast("string"))
    if sink == "quarantine":
        return rows.select("value", "date")
    struct = "position" if sink == "positions" else sink
    return rows.select(f"{struct}.*", "date").dropDuplicates(["mmsi", "received_at"])


def read_positions(spark: SparkSession, out_root: str) -> DataFrame:
    """The positions sink, one row per (mmsi, received_at)."""
    return read_sink(spark, out_root, "positions")


def capture_counts(spark: SparkSession, out_root: str) -> DataFrame:
    """One row: messages received, positions, voyages, rejected and other ones of all batches, and the files written."""
    names = ["received", *SINKS, "other"]
    counts = spark.read.parquet(f"{out_root}/counts").agg(*[F.sum(n).alias(n) for n in names])
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(f"{out_root}/messages").select("path"))
    written = files.agg(*[F.count_if(F.col("path").contains(f"/sink={s}/")).alias(f"{s}_files") for s in SINKS])
    return counts.join(written)  # one row each


def run_hourly_features(spark: SparkSession, out_root: str, out_dir: str, checkpoint: str) -> None:
    """Hour windows over arrival time of the captured positions, with a watermark (R7); append mode emits closed hours only."""
    captured = f"{out_root}/messages"
    rows = spark.readStream.schema(spark.read.parquet(captured).schema).parquet(captured)
    pos = rows.filter(F.col("sink") == "positions").select("position.*")
    agg = (pos.withColumn("_ts", parse_iso(F.col("received_at")).cast("timestamp")).withWatermark("_ts", "1 hour")
           .groupBy("mmsi", F.window("_ts", "1 hour").alias("w"))
           .agg(F.max_by(F.struct("lat", "lon", "sog"), F.col("_ts")).alias("_l"))
           .select("mmsi", F.col("w.start").cast("timestamp_ntz").alias("observation_hour"), "_l.*"))
    (agg.writeStream.outputMode("append").format("parquet").option("path", out_dir)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())

