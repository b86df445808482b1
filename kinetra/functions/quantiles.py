"""Exact quantiles and places in order for tables of any size: no task sees all rows of a column or group.

Distinct values are counted with partial sums and dealt into range partitions, which are written once to the shared
checkpoint folder, so a retried task cannot move a border. Running sums inside a partition, plus the totals of the partitions
before it, give the number of smaller rows; a quantile needs only the one or two values at its place.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared checkpoint folder; only a local master may do without a setting for it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed for loops, as a table of which the planner knows nothing.

    A checkpoint keeps the estimated size of its plan, which for a join is the product of both sides. Carried from round to round the
    estimate doubles its digits with every join, and after a few rounds it has millions: planning takes minutes.
    """
    done, spark = checkpointed(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def placed(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): how often each distinct value occurs within its keys, how many rows are smaller, and how many there are."""
    keys = list(keys)
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    parts = checkpointed(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    here = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # a row for each partition and key
    lower = here.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sums = parts.groupBy("_p", *keys).agg(F.sum("n").alias("_t"))
    # what lies before a partition enters its running sums as a row that comes first: a join would deal all values once more
    firsts = sums.select("_p", *keys, F.lit(None).cast(parts.schema[value].dataType).alias(value), F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("n"), F.sum("_t").over(here).alias("_total"))
    entries = firsts.withColumn("_value", F.lit(False)).unionByName(parts.withColumns({"_total": F.lit(None).cast("long"), "_value": F.lit(True)}))
    running = W.partitionBy("_p", *keys).orderBy("_value", value).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = entries.select(*keys, value, "n", (F.sum("n").over(running) - F.col("n")).alias("before"), F.first("_total").over(running).alias("total"), "_value")
    return out.where("_value").drop("_value")


def quantiles(df: DataFrame, features: Sequence[str], percents: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, feature, q array<double>): exact quantiles, linear between neighbours, of each feature in each group; nulls do not count, and a feature without values has no row."""
    names = [f"_g{k}" for k in range(len(groups))]
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.explode(items).alias("x")).select(*names, "x.*").where("value IS NOT NULL")
    at = placed(rows, [*names, "feature"], "value")
    targets = []
    for k, p in enumerate(percents):
        h = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(h)
        targets += [F.struct(F.lit(k).alias("k"), low.alias("place"), (1 - (h - low)).alias("weight")), F.struct(F.lit(k).alias("k"), F.ceil(h).alias("place"), (h - low).alias("weight"))]
    hits = at.select(*names, "feature", "value", F.filter(F.array(*targets), lambda x: (x["place"] >= F.col("before")) & (x["place"] < F.col("before") + F.col("n"))).alias("hits")).where(F.size("hits") > 0)
    sums = hits.select(*names, "feature", "value", F.explode("hits").alias("x")).groupBy(*names, "feature", "x.k").agg(F.sum(F.when(F.col("x.weight") > 0, F.col("value") * F.col("x.weight")).otherwise(0.0)).alias("v"))
    whole = sums.groupBy(*names, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("q"))
    return whole.select(*[F.col(n).alias(g) for g, n in zip(groups, names, strict=True)], "feature", "q")


def percentiles(df: DataFrame, features: Sequence[str], percents: Sequence[float]) -> dict[str, list[float]]:
    """By feature the exact quantiles, as numbers on the driver; features without values are missing."""
    return {r.feature: list(r.q) for r in quantiles(df, features, percents).collect()}


def medians(df: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Exact median of each feature by group, a column for each; a group without values is missing."""
    return quantiles(df, features, (0.5,), groups).groupBy(*groups).agg(*[F.max(F.when(F.col("feature") == f, F.col("q")[0])).alias(f) for f in features])
