"""Ranks over ranges, metrics, splits, gates and model comparison against Python."""

import datetime as dt
import hashlib
import json
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.operators.ranking import range_rank, range_sums
from tidewater.plans import features as FT
from tidewater.plans import ml as ML


def test_range_rank_with_a_hot_group(spark):
    """Nine tenths of the rows are of one group; ranks equal a sort, and the group lies in many ranges."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 10 else f"g{i % 70}", rng.randint(0, 30), rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, port string, a int, b double").repartition(7)
    got = {r.id: r["rank"] for r in range_rank(df, ["port"], [F.col("a").desc(), "b", "id"], "rank", ranges=16).collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r[2], r[3], r[0])):
        by[r[1]].append(r[0])
    assert got == {i: n for ids in by.values() for n, i in enumerate(ids, 1)}
    plan = range_rank(df, ["port"], ["a", "id"], "rank", ranges=16)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert range_rank(df.limit(0), ["port"], ["id"], "rank").count() == 0


def test_range_sums(spark):
    rows = [(i, (i * 37) % 1009, float(i % 5)) for i in range(1009)]
    df = spark.createDataFrame(rows, "id long, k int, w double")
    got = {r.k: (r.n, r.s) for r in range_sums(df, [F.col("k").desc()], {"n": F.lit(1), "s": F.col("w")}, ranges=9).collect()}
    n, s = 0, 0.0
    for _, k, w in sorted(rows, key=lambda r: -r[1]):
        n, s = n + 1, s + w
        assert got[k] == (n, s)


def metrics(scores, labels):
    pos, neg = sum(labels), len(labels) - sum(labels)
    out = {"roc_auc": None, "pr_auc": None}
    if pos and neg:
        wins = sum((a > b) + 0.5 * (a == b) for a, y in zip(scores, labels) if y for b, z in zip(scores, labels) if not z)
        out["roc_auc"] = wins / (pos * neg)
    if pos:
        out["pr_auc"] = sum(sum(y for a, y in zip(scores, labels) if a == t) / pos
                            * sum(y for a, y in zip(scores, labels) if a >= t) / sum(a >= t for a in scores) for t in set(scores))
    hits = [y for a, y in zip(scores, labels) if a >= 0.5]
    out["precision_at_0_5"] = sum(hits) / len(hits) if hits else 0.0
    out["recall_at_0_5"] = sum(hits) / pos if pos else 0.0
    out["brier_score"] = sum((a - y) ** 2 for a, y in zip(scores, labels)) / len(scores) if scores else None
    return out


@pytest.mark.parametrize("case", ["ties", "distinct", "positives", "negatives", "empty"])
def test_evaluate(spark, case):
    rng = random.Random(3)
    scores = [round(rng.random(), 1 if case == "ties" else 9) for _ in range(0 if case == "empty" else 300)]
    labels = [{"positives": 1, "negatives": 0}.get(case, int(rng.random() < s)) for s in scores]
    df = spark.createDataFrame(list(zip(scores, labels)), f"score double, {R.TARGET} int")
    got, want = ML.evaluate(df).first().asDict(), metrics(scores, labels)
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, abs_tol=1e-9)), k


def test_auc_gate(spark):
    df = lambda x: spark.createDataFrame([(x,)], "roc_auc double")
    assert ML.check_auc(df(0.65)) == 0.65
    for low in (0.6499, None):
        with pytest.raises(ValueError):
            ML.check_auc(df(low))


def test_stratified_split(spark):
    hour = dt.datetime(2024, 5, 1)
    rows = [(f"P{i % 7}", hour + dt.timedelta(hours=i), int(i % 9 == 0)) for i in range(203)]
    df = spark.createDataFrame(rows, f"port_code string, observation_hour timestamp_ntz, {R.TARGET} int")
    got = {(r.port_code, r.observation_hour): r.split for r in ML.stratified_split(df, ["port_code", "observation_hour"]).collect()}
    counts = Counter(r[2] for r in rows)
    quota = ML.class_quotas(dict(counts), 0.2)
    assert sum(quota.values()) == math.ceil(0.2 * 203) and abs(quota[1] - 0.2 * counts[1]) < 1
    for c in counts:
        own = sorted((r for r in rows if r[2] == c), key=lambda r: hashlib.md5(f"{r[0]}|{r[1]:%Y-%m-%d %H:%M:%S}|42".encode()).hexdigest())
        assert [got[r[0], r[1]] for r in own] == ["test"] * quota[c] + ["train"] * (len(own) - quota[c])
    assert ML.stratified_split(df.limit(0), ["port_code", "observation_hour"]).count() == 0


@pytest.mark.parametrize("counts", [{0: 5, 1: 5}, {0: 1, 1: 0}, {0: 7, 1: 3, 2: 1}, {0: 99, 1: 1}])
def test_class_quotas(counts):
    quota = ML.class_quotas(counts, 0.2)
    total = sum(counts.values())
    assert sum(quota.values()) == math.ceil(0.2 * total)
    assert all(abs(quota[c] - n / total * math.ceil(0.2 * total)) < 1 for c, n in counts.items())


def test_one_class_is_an_error(spark):
    one = spark.createDataFrame([(0,), (0,)], f"{R.TARGET} int")
    with pytest.raises(ValueError):
        ML.positive_weight(one)


def test_v2_needs_a_start_hour(spark):
    for nothing in (None, "", " "):
        with pytest.raises(ValueError):
            ML.dataset_v2(None, None, nothing)


def test_gate_raises(spark):
    df = spark.createDataFrame([(1,)] * 30, f"{R.TARGET} int")
    with pytest.raises(ValueError, match="rows"):
        ML.check_gate(df, min_rows=31, min_positive=1)
    with pytest.raises(ValueError, match="positive"):
        ML.check_gate(df, min_rows=1, min_positive=31)
    ML.check_gate(df, min_rows=30, min_positive=30)


def test_label_fan_out(spark):
    hour = dt.datetime(2024, 5, 2, 10)
    rows = [("P", hour, 5, "2024-05-02"), ("P", hour, 1, "2024-05-03"), ("P", hour + dt.timedelta(hours=1), 2, "2024-05-02")]
    df = spark.createDataFrame(rows, "port_code string, observation_hour timestamp_ntz, vessels_at_anchor long, date_partition string")
    pick = lambda **x: sorted((r.observation_hour.hour, r.date_partition, r.future_anchor) for r in FT.congestion_target(df, as_of="2024-05-03", **x).collect())
    assert pick() == [(10, "2024-05-02", 5), (10, "2024-05-03", 1), (11, "2024-05-02", 2)]
    assert pick(fan_out=True) == [(10, "2024-05-02", 1), (10, "2024-05-02", 5), (10, "2024-05-03", 1), (10, "2024-05-03", 5), (11, "2024-05-02", 2)]


def test_compare_models(spark, tmp_path):
    """Both models on one slice, metrics as computed by hand from their scores; the serving model's files stay as they were."""
    rng = random.Random(8)
    hour = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        x = {c: float(rng.randint(0, 9)) for c in R.FEATURES_V2}
        rows.append(("P", hour + dt.timedelta(hours=i), *x.values(), int(x["vessels_at_anchor"] + x["vessels_inbound"] + rng.random() > 9)))
    schema = "port_code string, observation_hour timestamp_ntz, " + ", ".join(f"{c} double" for c in R.FEATURES_V2) + f", {R.TARGET} int"
    df = spark.createDataFrame(rows, schema)
    serving, candidate = str(tmp_path / "v1"), str(tmp_path / "v2")
    ML.train_gbt(ML.with_weights(df, ML.positive_weight(df)), R.FEATURES_V1, max_iter=3).write().save(serving)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(serving) for f in fs}
    before = files()
    table, gains = ML.compare_models(spark, df, serving, candidate, max_iter=5)
    got = {(r.model, r.slice): r.asDict() for r in table.collect()}
    assert set(got) == {("candidate_v2", "validation"), ("candidate_v2", "test"), ("baseline_v1", "test")} and files() == before
    from pyspark.ml import PipelineModel
    test = ML.chronological_split(df).filter("split = 'test'")
    for name, path, cols in (("candidate_v2", candidate, R.FEATURES_V2), ("baseline_v1", serving, R.FEATURES_V1)):
        scored = ML.score(PipelineModel.load(path), test, cols).select("score", R.TARGET).collect()
        want = metrics([r[0] for r in scored], [r[1] for r in scored])
        assert len(scored) == 90 and all(math.isclose(got[name, "test"][k], v, abs_tol=1e-9) for k, v in want.items())
    assert got["candidate_v2", "test"]["roc_auc"] > got["baseline_v1", "test"]["roc_auc"]
    doc = json.loads(ML.comparison_report(df, table, gains).first().document)
    assert doc["rows"] == {"total": 600, "train": 420, "validation": 90, "test": 90} and list(doc["models"]) == ["baseline_v1", "candidate_v2"]
    order = [r.feature for r in gains.orderBy("rank").collect()]
    assert list(doc["feature_importance_gain"]) == order and len(order) == 16 and doc["promotion_note"]


def test_splits_make_their_dataset_once(spark):
    """Counts, ranges and rows of a split read what was written: the rows' own work is done once, whatever reads the parts."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    hour = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("P", hour + dt.timedelta(hours=i), i % 2) for i in range(40)],
                                 f"port_code string, observation_hour timestamp_ntz, {R.TARGET} int")
    for split in (ML.chronological_split, lambda d: ML.stratified_split(d, ["port_code", "observation_hour"])):
        seen.value = 0
        d = split(rows.mapInArrow(count, rows.schema))
        parts = {r.split: r["n"] for r in d.groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert sum(parts.values()) == 40 and d.filter("split = 'train'").count() == parts["train"]
        assert seen.value == 40
