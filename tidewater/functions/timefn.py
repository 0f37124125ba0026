"""Time helpers (X3-X5, X17): hour cuts stay TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hour_trunc(ts) -> Column:
    """Truncate to the hour (X3); result is TIMESTAMP_NTZ (session zone UTC)."""
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def day_trunc(ts) -> Column:
    return F.date_trunc("day", _c(ts)).cast("timestamp_ntz")


def parse_iso(text) -> Column:
    """ISO-8601 text (with or without offset) to TIMESTAMP_NTZ in UTC; bad text gives null."""
    t = _c(text)
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")),
    ).cast("timestamp_ntz")


def iso_text(ts) -> Column:
    """TIMESTAMP_NTZ (UTC) to ISO text with a +00:00 offset, seconds precision."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def date_text(ts) -> Column:
    """Partition text yyyy-MM-dd of a timestamp."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def hour_of_day(ts) -> Column:
    return F.hour(_c(ts)).cast("bigint")


def iso_day_of_week(ts) -> Column:
    """Monday = 1 ... Sunday = 7 (X5); Spark's dayofweek starts on Sunday, weekday on Monday = 0."""
    return (F.weekday(_c(ts)) + 1).cast("bigint")


def epoch_seconds(ts) -> Column:
    """Seconds since epoch of a UTC timestamp, for RANGE window frames."""
    return F.unix_seconds(_c(ts).cast("timestamp"))
