"""Descriptive statistics of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions.quantiles import medians, percentiles, quantiles
from kinetra.functions.stats import rank_rows

PERCENTS = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def _long(row: DataFrame, features: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One wide row f__name to one row for each feature."""
    items = [F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{n}").alias(n) for n in names]) for f in features]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """count, mean, std (ddof 1), min, exact percentiles, max of each feature."""
    aggs = []
    for f in features:
        c = F.col(f).cast("double")
        aggs += [F.count(c).alias(f"{f}__count"), F.avg(c).alias(f"{f}__mean"), F.stddev_samp(c).alias(f"{f}__std"), F.min(c).alias(f"{f}__min"), F.max(c).alias(f"{f}__max")]
    long = _long(df.agg(*aggs), features, ("count", "mean", "std", "min", "max")).join(quantiles(df, features, PERCENTS), "feature", "left")
    return long.select("feature", "count", "mean", "std", "min", *[F.col("q")[k].alias(f"p{int(p * 100):02d}") for k, p in enumerate(PERCENTS)], "max")


def skewness(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness G1; null under three values or without spread."""
    aggs = []
    for f in features:
        c = F.col(f).cast("double")
        n = F.count(c)
        aggs.append(F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).alias(f"{f}__skewness"))
    return _long(df.agg(*aggs), features, ("skewness",))


def zero_percentage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return _long(df.agg(*[(100.0 * F.avg((F.col(f) == 0).cast("double"))).alias(f"{f}__zero_pct") for f in features]), features, ("zero_pct",))


def iqr_outliers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Quartiles, the bounds 1.5 IQR beyond them, and how many values lie strictly outside."""
    found = percentiles(df, features, (0.25, 0.75))
    aggs = []
    for f in features:
        q1, q3 = (F.lit(x).cast("double") for x in found.get(f, (None, None)))
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        outside = (F.col(f) < lo) | (F.col(f) > hi)
        aggs += [F.first(q1).alias(f"{f}__q1"), F.first(q3).alias(f"{f}__q3"), F.first(q3 - q1).alias(f"{f}__iqr"), F.first(lo).alias(f"{f}__lower_bound"), F.first(hi).alias(f"{f}__upper_bound"), F.count_if(outside).alias(f"{f}__outlier_count"), (100.0 * F.avg(outside.cast("double"))).alias(f"{f}__outlier_pct")]
    return _long(df.agg(*aggs), features, ("q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_pct"))


def spearman(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long matrix (feature_a, feature_b, rho) of rank correlations."""
    _, table = rank_rows(df.select(*features), features)
    pairs = [(a, b) for a in features for b in features]
    row = table.agg(*[F.corr(f"{a}_rank", f"{b}_rank").alias(f"{a}__{b}") for a, b in pairs])
    items = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{a}__{b}").alias("rho")) for a, b in pairs]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def group_statistic(df: DataFrame, groups: Sequence[str], features: Sequence[str], how: str) -> DataFrame:
    """Exact median or mean of each feature by group."""
    if how == "median":
        return medians(df, groups, features)
    return df.groupBy(*groups).agg(*[F.avg(f).alias(f) for f in features])


def group_counts(df: DataFrame, groups: Sequence[str], total_of: Sequence[str] = ()) -> DataFrame:
    """count and percentage of each group, of all rows or of the rows that share the total_of columns."""
    from pyspark.sql import Window as W

    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy(*total_of) if total_of else W.partitionBy(F.lit(0))
    return counts.withColumn("percentage", 100.0 * F.col("count") / F.sum("count").over(w))


def eta_squared(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Between-group share of the sum of squares of each feature; 0 where there is no spread."""
    inner = df.groupBy(group).agg(*[F.struct(F.count(f).alias("n"), F.avg(F.col(f).cast("double")).alias("m"), F.var_pop(F.col(f).cast("double")).alias("v")).alias(f) for f in features])
    flat = inner.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("s")) for f in features])).alias("x")).select("x.feature", "x.s.*")
    sums = flat.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    return sums.select("feature", F.when(F.col("within") + between > 1e-12, between / (F.col("within") + between)).otherwise(0.0).alias("eta_squared"))
