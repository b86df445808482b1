"""Rank-based scores and gated choice of preprocessing and model candidates (small tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the three composite scores; the second item tells whether a lower value is better.
WITHIN_PIPELINE = {"silhouette": (0.35, False), "davies_bouldin": (0.25, True), "calinski_harabasz": (0.15, False), "seed_stability_ari_mean": (0.20, False), "minimum_cluster_share": (0.05, False)}
OVERALL = {"silhouette": (0.30, False), "davies_bouldin": (0.20, True), "seed_stability_ari_mean": (0.20, False), "hopkins_mean": (0.10, False), "balanced_accuracy_mean": (0.15, True), "minimum_cluster_share": (0.05, False)}
GATED = {"silhouette": (0.25, False), "davies_bouldin": (0.15, True), "bootstrap_ari_mean": (0.25, False), "bootstrap_ari_min": (0.20, False), "balanced_accuracy_mean": (0.10, True), "minimum_cluster_share": (0.05, False)}


def percentile_score(value: str, lower_is_better: bool, partition: tuple[str, ...] = ()) -> Column:
    """Average rank over the rows of the partition; null values have no rank and do not count as ties of others."""
    part = list(partition) or [F.lit(0)]
    ties = F.count(F.lit(1)).over(W.partitionBy(*part, value))
    r = F.rank().over(W.partitionBy(*part).orderBy(F.col(value).asc_nulls_last())) + (ties - 1) / 2.0
    n = F.count(value).over(W.partitionBy(*part))
    rows = F.count(F.lit(1)).over(W.partitionBy(*part))
    score = F.when(F.col(value).isNotNull(), r / n)
    return 1 - score + 1.0 / rows if lower_is_better else score


def composite(df: DataFrame, weights: dict[str, tuple[float, bool]], out: str, partition: tuple[str, ...] = ()) -> DataFrame:
    total = F.lit(0.0)
    for c, (weight, lower) in weights.items():
        total = total + weight * percentile_score(c, lower, partition)
    return df.withColumn(out, total)


def best_per_pipeline(sweep: DataFrame) -> DataFrame:
    scored = composite(sweep, WITHIN_PIPELINE, "within_pipeline_composite", ("pipeline",))
    w = W.partitionBy("pipeline").orderBy(F.desc("within_pipeline_composite"), F.desc("silhouette"), "k")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bootstrap_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline", "k").agg(F.avg("ari").alias("bootstrap_ari_mean"), F.median("ari").alias("bootstrap_ari_median"), F.min("ari").alias("bootstrap_ari_min"), F.count_if(F.col("ari") < 0.80).alias("bootstrap_unstable_repeats"), F.avg("min_cluster_share").alias("bootstrap_min_cluster_share_mean"), F.min("min_cluster_share").alias("bootstrap_min_cluster_share_min"))


def hopkins_summary(repeats: DataFrame) -> DataFrame:
    h = "hopkins_statistic"
    return repeats.groupBy("pipeline").agg(F.avg(h).alias("hopkins_mean"), F.stddev_samp(h).alias("hopkins_std"), F.min(h).alias("hopkins_min"), F.max(h).alias("hopkins_max"))


def gated_selection(candidates: DataFrame) -> DataFrame:
    """passes_gate and the gated score, -1 where the gate fails, best first."""
    gate = F.coalesce((F.col("bootstrap_ari_min") >= 0.80) & (F.col("bootstrap_unstable_repeats") == 0) & (F.col("bootstrap_min_cluster_share_min") >= 0.02), F.lit(False))
    scored = composite(candidates.withColumn("passes_gate", gate), GATED, "_s")
    return scored.withColumn("gated_score", F.when(F.col("passes_gate"), F.col("_s")).otherwise(-1.0)).drop("_s").orderBy(F.desc("passes_gate"), F.desc("gated_score"), "pipeline")


def family_leaderboard(benchmark: DataFrame) -> DataFrame:
    return benchmark.groupBy("model_family").agg(F.count(F.lit(1)).alias("configurations"), F.max("silhouette").alias("best_silhouette"), F.max("mean_feature_eta_squared").alias("best_eta_squared"), F.min("davies_bouldin").alias("best_davies_bouldin"))
