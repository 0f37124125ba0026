"""Ordered rebuild of the curated tables (S4, S18): each is written once, and the next ones read what was written.

A table has two slots.  A build writes the slot that is not in use and commits it, so readers see the old table or the new
one, and a build that dies changes nothing.  A reader that is still at work while two further builds finish must start again.
If a table fails, the run ends: the ones after it depend on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import features as FT
from tidewater.plans.news import news_records
from tidewater.sources.store import Store

#: Tables in the order of their dependencies.  The first three are read by several others.
TABLES = ["hourly_positions", "weather_hourly", "news_records", "feature_vessel_inbound_hourly", "event_port_attribution_hourly",
          "feature_event_signals_hourly", "feature_port_status_hourly", "congestion_target", "feature_vessel_state_hourly",
          "feature_port_status_hourly_v2"]

#: Written where they were made.  This table is the widest, has a row per vessel, port and hour, and comes out of few, full
#: tasks: to move it once more would cost as much as all moves before, to save files of some megabytes.
IN_PLACE = {"feature_vessel_state_hourly"}

#: Files a task may hold open in a write: the days of a lookback, and some.
OPEN_FILES, WRITERS = 128, "spark.sql.maxConcurrentOutputFileWriters"


def sink_curated(df: DataFrame, root: str, table: str, partition: str | None = "date_partition",
                 in_place: bool = False) -> int:
    """Replace a curated table; returns its rows, counted as they are written.

    Rows are brought together by partition before the write (AQE splits a large one and joins small ones), else every task
    would open a file in every partition.  ``in_place``: they are not, for large tables that come out of full tasks.
    A task keeps the files of its partitions open instead of sorting its rows by partition, up to ``OPEN_FILES``.
    """
    if partition and not in_place:
        df = df.hint("rebalance", partition)
    s = Store(df.sparkSession, f"{root.rstrip('/')}/{table}")
    number, seen = s.next_number(), Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(WRITERS)
    conf.set(WRITERS, OPEN_FILES)
    try:
        (writer.partitionBy(partition) if partition else writer).parquet(s.path(f"slot={number % 2}"))
    finally:
        conf.set(WRITERS, before)
    rows = int(seen.get["rows"])
    s.commit(number, number, True, rows, 0)
    return rows


def read_curated(spark: SparkSession, root: str, table: str, partition: str | None = "date_partition") -> DataFrame:
    """The committed table; its partition column is text, as it was written."""
    s = Store(spark, f"{root.rstrip('/')}/{table}")
    span = s.span()
    if span is None:
        raise FileNotFoundError(f"table {table} was never built below {root}")
    df = spark.read.parquet(s.path(f"slot={span[1] % 2}"))
    return df.withColumn(partition, F.col(partition).cast("string")) if partition else df


@dataclass
class Build:
    """One rebuild below ``root``.  ``as_of`` is resolved once, for all tables."""

    spark: SparkSession
    root: str
    positions: DataFrame
    voyage: DataFrame
    weather: DataFrame
    news: DataFrame
    ports: DataFrame
    as_of: FT.AsOf = None
    rows: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.as_of = FT.as_of_column(self.as_of, self.positions)

    def table(self, name: str) -> DataFrame:
        return read_curated(self.spark, self.root, name)

    def steps(self) -> dict[str, Callable[[], DataFrame]]:
        """How each table is made: raw frames are read by one table each, all others read written tables."""
        t, a = self.table, self.as_of
        return {
            "hourly_positions": lambda: FT.hourly_positions(self.positions, extended=True, as_of=a),
            "weather_hourly": lambda: FT.weather_hourly(self.weather, as_of=a),
            "news_records": lambda: news_records(self.news).withColumn("date_partition", F.substring("fetched_at", 1, 10)),
            "feature_vessel_inbound_hourly": lambda: FT.vessel_inbound_hourly(self.positions, self.ports, as_of=a,
                                                                              hourly=t("hourly_positions")),
            "event_port_attribution_hourly": lambda: FT.event_port_attribution_hourly(t("news_records").drop("date_partition")),
            "feature_event_signals_hourly": lambda: FT.event_signals_hourly(t("event_port_attribution_hourly")),
            "feature_port_status_hourly": lambda: FT.port_status_hourly(
                t("feature_vessel_inbound_hourly"), t("weather_hourly"), t("feature_event_signals_hourly")),
            "congestion_target": lambda: FT.congestion_target(t("feature_vessel_inbound_hourly"), as_of=a),
            "feature_vessel_state_hourly": lambda: FT.vessel_state_hourly(self.positions, self.voyage, self.ports, as_of=a,
                                                                          hourly=t("hourly_positions")),
            "feature_port_status_hourly_v2": lambda: FT.port_status_hourly_v2(
                t("feature_vessel_state_hourly"), t("weather_hourly"), t("feature_event_signals_hourly")),
        }

    def run(self) -> dict[str, int]:
        """Build all tables in order; the rows of each."""
        steps = self.steps()
        for name in TABLES:
            self.rows[name] = sink_curated(steps[name](), self.root, name, in_place=name in IN_PLACE)
        return self.rows


def sink_dataset(dataset: DataFrame, root: str, name: str) -> int:
    """Replace a training dataset: one folder, no partitions."""
    return sink_curated(dataset, root, name, partition=None)


def read_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_curated(spark, root, name, partition=None)

