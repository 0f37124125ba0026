"""Training datasets, splits, metrics, boosted trees and scoring.

Dataset grain is (port, hour): its size is bounded by ports x hours of the
lookback, not by the raw message volume, so the global orders used by the
chronological split stay small after aggregation.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import refdata as R
from tidewater.operators.ranking import range_rank, range_sums
from tidewater.session import written_once


def training_dataset(features: DataFrame, labels: DataFrame, feature_cols: list[str],
                     start_hour: str | None = None) -> DataFrame:
    """Features inner-joined with labels on (port, hour), optional start hour, ordered."""
    f = features.select("port_code", "observation_hour", *feature_cols)
    if start_hour is not None:
        f = f.filter(F.col("observation_hour") >= F.lit(start_hour).cast("timestamp_ntz"))
    t = labels.select("port_code", "observation_hour", R.TARGET)
    return f.join(t, ["port_code", "observation_hour"], "inner").orderBy("port_code", "observation_hour")


def dataset_v2(features: DataFrame, labels: DataFrame, start_hour) -> DataFrame:
    """The v2 training table (M2); the hour from which rows count is mandatory (F8)."""
    if start_hour is None or (isinstance(start_hour, str) and not start_hour.strip()):
        raise ValueError("a start hour is required for the v2 dataset")
    start = start_hour if isinstance(start_hour, Column) else F.lit(start_hour)
    return training_dataset(features.filter(F.col("observation_hour") >= start.cast("timestamp_ntz")), labels, R.FEATURES_V2)


def dataset_gate(dataset: DataFrame, min_rows: int = 1000, min_positive: int = 20) -> DataFrame:
    """Rows, positives, positive rate and the gate outcome in one aggregate."""
    y = F.col(R.TARGET)
    return (dataset.agg(F.count("*").alias("rows"), F.count_if(y > 0).alias("positives"))
            .withColumn("positive_rate", F.try_divide(F.col("positives"), F.col("rows")))
            .withColumn("gate_passed", (F.col("rows") >= min_rows) & (F.col("positives") >= min_positive)))


def check_gate(dataset: DataFrame, min_rows: int = 1000, min_positive: int = 20) -> None:
    """Raise like the dataset builder when a gate fails (F8/A24 check)."""
    row = dataset_gate(dataset, min_rows, min_positive).first()
    if row["rows"] < min_rows:
        raise ValueError(f"dataset has {row['rows']} rows; need at least {min_rows}")
    if row["positives"] < min_positive:
        raise ValueError(f"dataset has {row['positives']} positive rows; need at least {min_positive}")


def chronological_split(dataset: DataFrame, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """First 70 % of rows by hour train, next 15 % validation, rest test.

    No global window over rows: hourly counts (one row per hour) are
    cumulated, each row's index is its hour's offset plus its rank inside the
    hour (tie-break port code), and the cut points come from the total.
    The dataset is written once: the counts, the rows and every part of the
    split read it, and would else make it anew each.
    """
    dataset = written_once(dataset, "split")
    hourly = dataset.groupBy("observation_hour").agg(F.count("*").alias("_n"))
    w = Window.orderBy("observation_hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hourly.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
               .withColumn("_total", F.sum("_n").over(Window.partitionBy())))
    d = dataset.join(offsets.select("observation_hour", "_off", "_total"), "observation_hour")
    idx = F.col("_off") + F.row_number().over(Window.partitionBy("observation_hour").orderBy("port_code")) - 1
    d = d.withColumn("_idx", idx)
    t_end = F.floor(F.col("_total") * train)
    v_end = F.floor(F.col("_total") * val)
    split = F.when(F.col("_idx") < t_end, "train").when(F.col("_idx") < v_end, "validation").otherwise("test")
    return d.withColumn("split", split).drop("_off", "_total", "_idx")


def class_quotas(counts: dict, test_fraction: float) -> dict:
    """Test rows of each class: their share of ceil(fraction x rows), whole parts first, then by the largest rest."""
    total = sum(counts.values())
    wanted = math.ceil(test_fraction * total)
    share = {c: Fraction(n * wanted, total) for c, n in counts.items()}
    quota = {c: int(x) for c, x in share.items()}
    for c in sorted(counts, key=lambda c: (quota[c] - share[c], c))[:wanted - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_split(dataset: DataFrame, key_cols: list[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded split with exact class shares (M3): a class's first rows by the MD5 of their keys and the seed are test rows.

    Any engine computes the same order.  Rows are numbered over ranges of (class, digest); the driver holds class counts only.
    The dataset is written once, for the counts, the ranges' sample and the rows.
    """
    dataset = written_once(dataset, "split")
    if dataset.schema[R.TARGET].nullable:
        dataset = dataset.filter(F.col(R.TARGET).isNotNull())
    texts = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if dict(dataset.dtypes)[c].startswith("timestamp") else F.col(c).cast("string") for c in key_cols]
    digest = F.md5(F.concat_ws("|", *texts, F.lit(str(seed))))
    counts = {r[R.TARGET]: r["n"] for r in dataset.groupBy(R.TARGET).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return dataset.withColumn("split", F.lit("train"))
    quota = class_quotas(counts, test_fraction)
    d = range_rank(dataset.withColumn("_h", digest), [R.TARGET], [F.col("_h"), *[F.col(c) for c in key_cols]], "_rank")
    test = reduce(lambda a, b: a | b, [(F.col(R.TARGET) == c) & (F.col("_rank") <= n) for c, n in quota.items()])
    return d.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_rank")


def class_weight(train: DataFrame) -> DataFrame:
    """negatives / positives of the training rows (M4)."""
    y = F.col(R.TARGET)
    return train.agg(F.count_if(y == 0).alias("negatives"), F.count_if(y == 1).alias("positives")) \
        .withColumn("scale_pos_weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives")))


def positive_weight(train: DataFrame) -> Column:
    """negatives / positives as a literal; training data of one class is an error."""
    row = class_weight(train).first()
    if not row["negatives"] or not row["positives"]:
        raise ValueError("training data must hold both classes")
    return F.lit(float(row["scale_pos_weight"]))


def with_weights(train: DataFrame, weight: Column) -> DataFrame:
    return train.withColumn("weight", F.when(F.col(R.TARGET) == 1, weight).otherwise(F.lit(1.0)))


def fill_features(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Null features -> 0 (serving rule, and v2 training)."""
    return df.fillna(0, subset=feature_cols).fillna(0.0, subset=feature_cols)


def train_gbt(train: DataFrame, feature_cols: list[str], *, max_iter: int = 100, step: float = 0.05,
              max_depth: int = 5, subsample: float = 0.8, min_instances: int = 20, seed: int = 42,
              weight_col: str | None = "weight"):
    """Gradient-boosted trees (M5): pyspark.ml pipeline of VectorAssembler + GBTClassifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=R.TARGET, featuresCol="features", maxIter=max_iter, stepSize=step,
                        maxDepth=max_depth, subsamplingRate=subsample, minInstancesPerNode=min_instances, seed=seed)
    if weight_col:
        gbt.setWeightCol(weight_col)
    return Pipeline(stages=[asm, gbt]).fit(train)


def importance(model, feature_cols: list[str], spark) -> DataFrame:
    """Ranked feature importances (M7)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(feature_cols, imp), key=lambda r: -r[1])
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def probability() -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col("probability"))[1]


def evaluate(scored: DataFrame, score_col: str = "score", label_col: str = R.TARGET) -> DataFrame:
    """ROC AUC, average precision, precision and recall at 0.5, Brier (M6), one row.

    Rows are first aggregated per distinct score (positives, negatives); running sums over that table come from ranges of
    the scores.  ROC AUC uses mid-ranks for ties; average precision is the step sum over distinct thresholds (not
    trapezoids).  ROC AUC is null unless both classes occur; average precision is null without a positive.
    """
    y = F.col(label_col).cast("double")
    s = F.col(score_col).cast("double")
    per = scored.groupBy(s.alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    per = range_sums(per, [F.col("s").desc()], {"_tp": F.col("pos"), "_fp": F.col("neg")})
    totals = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    positives, negatives = F.lit(totals["P"] or 0.0), F.lit(totals["N"] or 0.0)
    # rows with a smaller score: all but those of this score and above
    rank = positives + negatives - F.col("_tp") - F.col("_fp") + (F.col("pos") + F.col("neg") + 1) / 2
    agg = per.agg(
        F.sum(F.col("pos") * rank).alias("_rank_sum"),
        F.sum(F.try_divide(F.col("pos"), positives) * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_ap"),
        # the threshold metrics follow from the same table: the input is read once
        F.sum(F.when(F.col("s") >= 0.5, F.col("pos")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(F.col("s") >= 0.5, F.col("pos") + F.col("neg")).otherwise(0.0)).alias("pp"),
        F.try_divide(F.sum(F.col("pos") * (1 - F.col("s")) * (1 - F.col("s")) + F.col("neg") * F.col("s") * F.col("s")),
                     F.sum(F.col("pos") + F.col("neg"))).alias("brier_score"))
    auc = F.when((positives > 0) & (negatives > 0),
                 F.try_divide(F.col("_rank_sum") - positives * (positives + 1) / 2, positives * negatives))
    return agg.select(auc.alias("roc_auc"), F.when(positives > 0, F.col("_ap")).alias("pr_auc"),
                      F.coalesce(F.try_divide(F.col("tp"), F.col("pp")), F.lit(0.0)).alias("precision_at_0_5"),
                      F.coalesce(F.try_divide(F.col("tp"), positives), F.lit(0.0)).alias("recall_at_0_5"),
                      "brier_score")


#: Least ROC AUC of a model that may be saved (fixed value).
LEAST_AUC = 0.65


def check_auc(metrics: DataFrame, least: float = LEAST_AUC) -> float:
    """The ROC AUC of a row of ``evaluate``; one that is missing or below the gate is an error (M6)."""
    auc = metrics.first()["roc_auc"]
    if auc is None or auc < least:
        raise ValueError(f"ROC AUC is {auc}; at least {least} is required")
    return auc


def score(model, rows: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Rows with the model's probability of congestion as ``score``; null features count 0."""
    return model.transform(fill_features(rows, feature_cols)).withColumn("score", probability()).drop("features", "rawPrediction", "probability", "prediction")


def compare_models(spark, dataset: DataFrame, baseline_path: str, candidate_path: str, *, max_iter: int = 150) -> tuple[DataFrame, DataFrame]:
    """Metric rows of a new v2 candidate and of the saved v1 baseline on one test slice, and the candidate's importances (M8).

    The candidate is trained on the first 70 % of hours, saved to its own folder and read back; the baseline is only read.
    Promotion is another step.
    """
    from pyspark.ml import PipelineModel
    d = chronological_split(fill_features(dataset, R.FEATURES_V2))
    part = {k: d.filter(F.col("split") == k) for k in ("train", "validation", "test")}
    model = train_gbt(with_weights(part["train"], positive_weight(part["train"])), R.FEATURES_V2, max_iter=max_iter)
    model.write().overwrite().save(candidate_path)
    candidate, baseline = PipelineModel.load(candidate_path), PipelineModel.load(baseline_path)
    rows = [("candidate_v2", "validation", candidate, R.FEATURES_V2), ("candidate_v2", "test", candidate, R.FEATURES_V2),
            ("baseline_v1", "test", baseline, R.FEATURES_V1)]
    measured = [evaluate(score(m, part[s], cols)).select(F.lit(name).alias("model"), F.lit(s).alias("slice"), "*") for name, s, m, cols in rows]
    return reduce(DataFrame.union, measured), importance(candidate, R.FEATURES_V2, spark)


PROMOTION_NOTE = "Serving is not updated. Promote only after this report was reviewed against the v1 baseline."


def comparison_report(dataset: DataFrame, metrics: DataFrame, gains: DataFrame) -> DataFrame:
    """One row with the comparison as JSON text: rows of each slice, positives, metrics by model and slice, importances."""
    counts = chronological_split(dataset).agg(
        F.struct(F.count("*").alias("total"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")]).alias("rows"),
        F.count_if(F.col(R.TARGET) > 0).alias("positive_rows"))
    measures = [c for c in metrics.columns if c not in ("model", "slice")]
    by_slice = metrics.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slice", F.struct(*measures))))).alias("m"))
    by_name = lambda a, b: F.when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0)
    models = by_slice.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "m")), by_name)).alias("models"))
    ranked = gains.agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "importance"))).alias("g")).select(
        F.map_from_entries(F.transform("g", lambda x: F.struct(x["feature"], x["importance"]))).alias("feature_importance_gain"))
    whole = counts.join(models).join(ranked)  # one row each
    return whole.select(F.to_json(F.struct("rows", "positive_rows", "models", "feature_importance_gain", F.lit(PROMOTION_NOTE).alias("promotion_note")),
                                  {"ignoreNullFields": "false"}).alias("document"))


def latest_per_port(features: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Most recent feature row per port (T1): one grouped max_by(struct) for all ports."""
    return (features.groupBy("port_code")
            .agg(F.max_by(F.struct("observation_hour", *feature_cols), F.col("observation_hour")).alias("_l"))
            .select("port_code", "_l.*"))


def score_latest(model, features: DataFrame, ports: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Latest row per port, nulls -> 0, class at 0.5 of the unrounded probability, then 4 decimals (M9).

    ``as_of`` is the row's own hour; a port without data gets nulls.
    """
    latest = fill_features(latest_per_port(features, feature_cols), feature_cols)
    scored = model.transform(latest).select(
        "port_code", "observation_hour", F.round(probability(), 4).alias("congestion_probability"),
        (probability() >= 0.5).cast("int").alias("predicted_congested"), F.col("observation_hour").alias("as_of"))
    return ports.select("port_code").join(scored, "port_code", "left")
