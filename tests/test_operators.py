"""Rewrite equivalence: grid distance join, as-of join and range windows against brute force."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewater.operators.spatial import distance_join, nearest_in_reach
from tidewater.operators.temporal import asof_join


def _hav(lat1, lon1, lat2, lon2):
    a = (math.sin(math.radians(lat1 - lat2) / 2) ** 2 + math.cos(math.radians(lat2)) * math.cos(math.radians(lat1))
         * math.sin(math.radians(lon1 - lon2) / 2) ** 2)
    return 3440.065 * 2 * math.asin(math.sqrt(min(1.0, a)))


def test_distance_join_equals_brute_force(spark):
    rnd = random.Random(7)
    sites = [(f"S{i}", rnd.uniform(-85, 85), rnd.uniform(-180, 180)) for i in range(40)]
    sites += [("POLE", 88.5, 10.0), ("DATELINE", 10.0, 179.9)]
    pts = []
    for i in range(3000):
        code, la, lo = rnd.choice(sites)
        pts.append((i, max(-90.0, min(90.0, la + rnd.uniform(-5, 5))), ((lo + rnd.uniform(-8, 8) + 180) % 360) - 180))
    pdf = spark.createDataFrame(pts, "id long, lat double, lon double")
    sdf = spark.createDataFrame(sites, "port_code string, port_lat double, port_lon double")
    for r in (50.0, 200.0):
        got = {(x.id, x.port_code) for x in distance_join(pdf, sdf, r).select("id", "port_code").collect()}
        want = {(i, c) for i, la, lo in pts for c, sla, slo in sites if _hav(la, lo, sla, slo) <= r}
        assert got == want
        near = {x.id: (x.port_code, x.distance_nm) for x in nearest_in_reach(pdf, sdf, r).collect()}
        assert len(near) == len(pts)
        for i, la, lo in pts:
            best = min(((_hav(la, lo, sla, slo), c) for c, sla, slo in sites), default=None)
            if best[0] > r:
                assert near[i] == (None, None)
            else:
                assert near[i][0] == best[1] and abs(near[i][1] - best[0]) < 1e-6
    twins = sdf.filter("port_code = 'S0'").union(sdf.filter("port_code = 'S0'").withColumn("port_code", F.lit("A")))
    at = twins.limit(1).select(F.lit(1).alias("id"), F.col("port_lat").alias("lat"), F.col("port_lon").alias("lon"))
    assert [x.port_code for x in nearest_in_reach(at, twins, 50.0).collect()] == ["A"]  # a tie


def test_asof_join_equals_brute_force(spark):
    rnd = random.Random(3)
    left = [(k, i, rnd.randint(0, 200_000)) for k in range(5) for i in range(60)]
    right = [(k, j, rnd.randint(0, 200_000)) for k in range(4) for j in range(80)]
    ldf = spark.createDataFrame(left, "k long, i long, t long").withColumn("ts", F.col("t").cast("timestamp"))
    rdf = spark.createDataFrame(right, "k long, j long, t long").withColumn("ts", F.col("t").cast("timestamp"))
    for strict in (True, False):
        for direction in ("backward", "forward"):
            got = asof_join(ldf, rdf, by=["k"], left_time=F.col("ts"), right_time="ts", payload=["j", "t"],
                            strict=strict, bucket_seconds=3600, tiebreak="j", direction=direction)
            res = {(r.k, r.i): (r["_asof"]["j"] if r["_asof"] else None) for r in got.collect()}
            for k, i, t in left:
                cands = [(rt, j) for rk, j, rt in right if rk == k and (
                    (rt < t if strict else rt <= t) if direction == "backward" else (rt > t if strict else rt >= t))]
                if direction == "backward":
                    want = max(cands)[1] if cands else None
                else:
                    want = min(cands)[1] if cands else None
                assert res[(k, i)] == want, (strict, direction, k, i, t)


def test_asof_join_with_one_left_row_per_bucket(spark):
    """Left rows in the order of their key: the same rows as by the join, nulls in keys and times included."""
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    left = [(k, i, base + dt.timedelta(hours=h)) for i, (k, h) in enumerate(
        {(rng.choice([1, 2, 3, None]), rng.randint(0, 60)) for _ in range(120)})] + [(1, 500, None), (9, 501, base)]
    right = [(rng.choice([1, 2, 3, None]), j, base + dt.timedelta(minutes=30 * rng.randint(0, 130)), None if j % 7 == 0 else f"p{j}")
             for j in range(80)]
    ldf = spark.createDataFrame(left, "k long, i int, hour timestamp_ntz").repartition(5)
    rdf = spark.createDataFrame(right, "k long, j int, ts timestamp_ntz, d string").repartition(3)

    def joined(**one):
        return asof_join(ldf, rdf, by=["k"], left_time=F.col("hour") + F.expr("INTERVAL 1 HOUR"), right_time="ts", payload=["j", "d"],
                         left_time_at_bucket_end=True, tiebreak="j", **one)

    def rows(df):
        return {r.i: (r.k, r.hour, r["_asof"] and tuple(r["_asof"])) for r in df.collect()}

    new = joined(left_row_per_bucket=True)
    assert rows(new) == rows(joined()) and len(rows(new)) == len(left)
    want = {i: max(((t, j) for kk, j, t, _ in right if k is not None and kk == k and h is not None and t < h + dt.timedelta(hours=1)),
                   default=(None, None))[1] for k, i, h in left}
    assert {i: a and a[0] for i, (_, _, a) in rows(new).items()} == want


def test_vessel_states_are_moved_once_by_vessel(spark):
    """The widest rows pass two shuffles: to the hour's last position, and to their vessel's order."""
    from tidewater.plans import features as FT
    from tidewater.sources.derived import Inputs
    inp = Inputs(spark, SF_SMALL)
    hourly = FT.hourly_positions(inp.positions, extended=True).localCheckpoint()
    state = FT.vessel_state_hourly(inp.positions, inp.voyage, inp.ports, hourly=hourly)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2  # latest voyages of an hour; hours and voyages by vessel
    assert "port_code" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(" in x)
