"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import remove_table, written


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its partners v. Partial sums make a hub no hot key."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component of each node that has an edge. edges: (a, b), any order, repeats allowed; nodes must not be null.

    A round is two joins on u whose skewed partitions Spark may split, and one written table of at most as many edges as
    before; the lineage is cut there. Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    current, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_minima(large), "u")
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after, new_path = written(star, "edges")
        remove_table(spark, path)
        current, path = after, new_path
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
