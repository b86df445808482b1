"""Samples of an exact size without a sort, a list on the driver or one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import sampling


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7).alias("g")).repartition(5).cache()


@pytest.mark.parametrize("cell", [10_000, 3, 1])
def test_uniform_samples_are_the_first_by_hash(spark, table, monkeypatch, cell):
    monkeypatch.setattr(sampling, "LAST_CELL", cell)
    ordered = [r.key for r in table.orderBy(F.xxhash64("key", F.lit(5)), "key").collect()]
    for n in (0, 1, 777, 24_000, 29_999, 30_000, 40_000):
        got = sampling.uniform_sample(table, "key", n, 5)
        assert sorted(r.key for r in got.collect()) == sorted(ordered[:n])
    plan = sampling.uniform_sample(table, "key", 24_000, 5)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("TakeOrdered", "Sort", "Exchange SinglePartition", "BroadcastExchange"))


def test_equal_hashes_break_by_key(spark):
    df = spark.range(50).withColumn("h", F.when(F.col("id") < 45, 7).otherwise(-F.col("id")))
    for n in (3, 5, 6, 20, 49):
        got = sorted(r.id for r in df.where(sampling._within_first(df, F.col("h").cast("long"), F.col("id"), n)).collect())
        assert got == sorted([49, 48, 47, 46, 45][:n] + list(range(max(0, n - 5))))


def test_bootstrap_draws_exactly_n(spark, table):
    counts = {r.key: r["count"] for r in sampling.bootstrap_sample(table, "key", 24_000, 3).groupBy("key").count().collect()}
    assert sum(counts.values()) == 24_000
    again = {r.key: r["count"] for r in sampling.bootstrap_sample(table.repartition(11), "key", 24_000, 3).groupBy("key").count().collect()}
    assert counts == again != {r.key: r["count"] for r in sampling.bootstrap_sample(table, "key", 24_000, 4).groupBy("key").count().collect()}
    seen = np.bincount(list(counts.values()), minlength=5)
    seen[0] = 30_000 - len(counts)
    rate = 0.8
    want = 30_000 * np.exp(-rate) * np.array([1, rate, rate**2 / 2, rate**3 / 6, rate**4 / 24])
    assert np.abs(seen[:5] - want).max() < 300  # draws are even: multiplicities are near Poisson ones
    plan = sampling.bootstrap_sample(table, "key", 24_000, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    numbers = spark.range(40).withColumnRenamed("id", "i")
    assert sampling.bootstrap_sample(numbers, "i", 100, 1).count() == 100 and sampling.bootstrap_sample(numbers.limit(0), "i", 10, 1).count() == 0


def test_group_subsamples(spark, table):
    kept = sampling.group_subsample(table, ["g"], 0.6, 2)
    assert kept.select("g").distinct().count() == 4 and kept.count() == sum(1 for k in range(30_000) if k % 7 in {r.g for r in kept.select("g").distinct().collect()})
