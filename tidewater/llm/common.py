"""Helpers shared by the training-data operators: table reads, scratch tables, text slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import scratch_path

#: Bytes of text that a Python task turns into Python objects at once.
SLICE_BYTES = 3_000_000
#: Rows and bytes of an Arrow batch between the JVM and a Python task.
BATCH_ROWS = 2_000
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors,
    and gives the optimizer an exact size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(text: str, most: Column) -> Column:
    """The column ``text``; of one over ``most`` characters, four stretches from its beginning to its end."""
    n, part = F.length(text), F.floor(most / 4).cast("int")
    cut = [F.substring(F.col(text), F.floor((n - part) * k / 3).cast("int") + 1, part) for k in range(4)]
    return F.when(n <= most, F.col(text)).otherwise(F.concat_ws("\n", *cut))


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after a bound on the Arrow batches of its session: texts cross to Python a few megabytes at a time
    (one row at least), in the JVM's buffers as well as in the Python tasks."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            base = int(size[at - 1]) if at else 0
            to = max(at + 1, int(size.searchsorted(base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
