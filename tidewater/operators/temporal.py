"""Temporal operators: as-of join (J7, D8, D10) and hour-keyed range windows.

As-of join, scalable form.  Right rows are first reduced to the latest row per
(key, time bucket) with a grouped ``max_by`` (partial aggregation before the
shuffle, so a hot key collapses map-side).  The reduced rows and the left rows'
(key, bucket) markers are then ordered per key by bucket and carried forward
with ``last_value(... IGNORE NULLS)``; a key holds at most one row per bucket,
so even a key with a third of all raw rows stays small.  Left rows whose time
is not a bucket end additionally get the within-bucket match from a window
over (key, bucket).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.timefn import epoch_seconds


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_time: Column, right_time: str,
              payload: list[str], strict: bool = True, bucket_seconds: int = 3600,
              left_time_at_bucket_end: bool = False, left_row_per_bucket: bool = False, tiebreak: str | None = None,
              direction: str = "backward", out_col: str = "_asof") -> DataFrame:
    """Attach to every left row the right row with the latest ``right_time`` before ``left_time``.

    ``strict``: right time < left time (else <=).  ``direction='forward'`` takes
    the earliest right row at or after the left time instead (for next-event
    lookups).  The matched payload comes back as struct column ``out_col``
    (null when unmatched: left rows are never dropped).  One struct, not one
    value per field, because the latest row may itself hold nulls.
    ``left_time_at_bucket_end``: every left time is an exact bucket boundary
    (e.g. hour + 1 h with hourly buckets), so the within-bucket step is skipped.
    ``left_row_per_bucket``: left also holds at most one row per key and bucket, so its rows themselves stand in the order
    of their key: they are moved once, by ``by`` alone, and a window over more columns needs no other shuffle.
    """
    b_us = bucket_seconds * 1_000_000
    fwd = direction == "forward"
    order_key = [F.col(right_time)] + ([F.col(tiebreak)] if tiebreak else [])
    rt = right.select(*by, F.col(right_time).alias("_rt"), *( [F.col(tiebreak).alias("_tb")] if tiebreak else []),
                      F.struct(*[F.col(c) for c in payload], F.col(right_time).alias("matched_time")).alias("_p"))
    rt = rt.withColumn("_rb", F.floor(_micros(F.col("_rt")) / b_us))
    ord_struct = F.struct(F.col("_rt"), *( [F.col("_tb")] if tiebreak else []))
    pick = F.min_by if fwd else F.max_by
    summary = rt.groupBy(*by, "_rb").agg(pick(F.col("_p"), ord_struct).alias("_p"))

    lt_us = _micros(left_time)
    # bucket a left row belongs to: the one holding the instants it may match
    if fwd:
        lb = F.floor(lt_us / b_us) if not strict else F.floor((lt_us + 1) / b_us)
    else:
        lb = F.floor((lt_us - (1 if strict else 0)) / b_us)
    lf = left.withColumn("_lt", left_time).withColumn("_lb", lb)

    if left_time_at_bucket_end and left_row_per_bucket and not fwd:
        lrows = lf.drop("_lt").withColumnRenamed("_lb", "_rb").withColumn("_side", F.lit(0))
        u = lrows.unionByName(summary.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy(F.col("_rb").asc(), F.col("_side").desc()) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # nulls equal nothing, as in a join
        keyed = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, "_rb"]])
        return (u.withColumn(out_col, F.when(keyed, F.last("_p", ignorenulls=True).over(w)))
                .filter(F.col("_side") == 0).drop("_rb", "_side", "_p"))

    # carried value from whole buckets strictly before (backward) / after (forward) the left bucket,
    # or including it when left times sit on bucket ends
    include_same = left_time_at_bucket_end and not fwd
    marks = lf.select(*by, F.col("_lb").alias("_rb")).distinct().withColumn("_side", F.lit(0)) \
        .withColumn("_p", F.lit(None).cast(summary.schema["_p"].dataType))
    summ = summary.withColumn("_side", F.lit(1))
    u = marks.unionByName(summ.select(*by, "_rb", "_side", "_p"))
    if fwd:
        w = Window.partitionBy(*by).orderBy(F.col("_rb").desc(), F.col("_side").asc()) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        side_order = F.col("_side").desc() if include_same else F.col("_side").asc()
        w = Window.partitionBy(*by).orderBy(F.col("_rb").asc(), side_order) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (u.withColumn("_c", F.last("_p", ignorenulls=True).over(w))
               .filter(F.col("_side") == 0).select(*by, F.col("_rb").alias("_lb"), "_c"))
    out = lf.join(carried, by + ["_lb"], "left")

    if include_same:
        return out.withColumnRenamed("_c", out_col).drop("_lt", "_lb")

    # within-bucket match: union left markers and right rows of the same (key, bucket)
    lrows = lf.select(*by, "_lb", "_lt").distinct()
    lu = lrows.select(*by, F.col("_lb").alias("_b"), F.col("_lt").alias("_t"),
                      *( [F.lit(None).cast(rt.schema["_tb"].dataType).alias("_tb")] if tiebreak else []),
                      F.lit(0 if strict else 2).alias("_side"),
                      F.lit(None).cast(rt.schema["_p"].dataType).alias("_p"))
    ru = rt.select(*by, F.col("_rb").alias("_b"), F.col("_rt").alias("_t"), *( ["_tb"] if tiebreak else []),
                   F.lit(1).alias("_side"), "_p")
    ww_order = [F.col("_t").desc() if fwd else F.col("_t").asc(), F.col("_side").asc()]
    if tiebreak:
        ww_order.append(F.col("_tb").desc() if fwd else F.col("_tb").asc())
    ww = Window.partitionBy(*by, "_b").orderBy(*ww_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = (lu.unionByName(ru).withColumn("_w", F.last("_p", ignorenulls=True).over(ww))
              .filter(F.col("_side") != 1).select(*by, F.col("_b").alias("_lb"), F.col("_t").alias("_lt"), "_w"))
    out = out.join(within, by + ["_lb", "_lt"], "left")
    return out.withColumn(out_col, F.coalesce(F.col("_w"), F.col("_c"))).drop("_w", "_c", "_lt", "_lb")


def hourly_range_sums(df: DataFrame, *, partition: list[str], hour_col: str,
                      sums: dict[str, tuple[str, int]]) -> DataFrame:
    """Trailing sums over hour-keyed rows with RANGE frames.

    ``sums``: output -> (input column, hours); the frame is (T - hours h, T],
    i.e. ``RANGE BETWEEN (hours-1)*3600 PRECEDING AND CURRENT ROW`` on epoch
    seconds, exact for hour-aligned keys.  Rows must already be one per
    (partition, hour), so a partition holds at most one row per hour.
    """
    t = epoch_seconds(F.col(hour_col))
    out = df.withColumn("_t", t)
    for name, (src, hours) in sums.items():
        w = Window.partitionBy(*partition).orderBy("_t").rangeBetween(-(hours - 1) * 3600, 0)
        out = out.withColumn(name, F.sum(F.col(src)).over(w))
    return out.drop("_t")
