"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm_value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm_value(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm_value(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm_value(v.asDict())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if v is None:
        return "None"
    return str(v)


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm_value(r[i]) for i in order) for r in rows)


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, sf_dir, qfn, sql):
    t0 = time.time()
    df = qfn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    a, b = rows_key(scols, srows), rows_key(dcols, drows)
    ok = ok_cols and a == b
    print(f"{'OK ' if ok else 'BAD'} {name}: spark {len(srows)} rows ({t1 - t0:.1f}s), duck {len(drows)} rows"
          + ("" if ok_cols else f" cols spark={sorted(scols)} duck={sorted(dcols)}"), flush=True)
    if not ok and ok_cols:
        sa, sb = set(a), set(b)
        for x in list(sa - sb)[:3]:
            print("   spark-only:", x)
        for x in list(sb - sa)[:3]:
            print("   duck-only: ", x)
    return ok


def main():
    import importlib
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    entry = importlib.import_module("__spark_entry__")
    from tidewater.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_connect(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in os_:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"-- {name}: no oracle, {n} rows ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            if not compare(spark, con, name, sf_dir, fn, os_[name]):
                bad.append(name)
        except Exception as e:  # report and go on
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:800]}", flush=True)
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
