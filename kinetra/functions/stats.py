"""Statistical expressions and small driver-side formulas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.functions.quantiles import checkpointed, placed

#: The 97.5 % point of the normal distribution.
Z_95 = 1.959963984540054


def average_rank(value: str, partition: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean, within the partition columns (one task for each partition value)."""
    base = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    ties = W.partitionBy(*partition, value)
    return F.rank().over(base.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def _splits(bounds: Sequence[float]) -> list[float]:
    """Ends of intervals over all numbers, in which zero and each bound are intervals of their own."""
    own = {0.0, *(x + 0.0 for x in bounds)}
    return sorted({-math.inf, math.inf, *own, *(math.nextafter(x, math.inf) for x in own)})


def rank_rows(df: DataFrame, values: Sequence[str], suffix: str = "_rank") -> tuple[DataFrame, DataFrame]:
    """(df with a number `_row`, `_row` and the average rank of each numeric value column as a double), for tables of any size.

    Each column is cut into about two thousand intervals, at estimated quantiles that are intervals themselves; the rows of all are counted in
    one layout, so the number of exchanges does not grow with the columns. A value that is an interval, as each is that holds over some
    thousandths of a column, gets its rank from the counts, so no task sees all copies of a frequent value. Only the other values are
    shuffled, to be ranked within their interval; the first of a row takes its other ranks along, and rows with several of them meet by number.
    Estimates decide on the work, not on the ranks. Nulls rank as null.
    """
    import pyarrow as pa
    from pyspark.ml.feature import Bucketizer

    table = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))  # written, so that a retried task numbers no row anew
    ks = range(len(values))
    numbers = table.select("_row", *[(F.col(v).cast("double") + 0.0).alias(f"_v{k}") for k, v in enumerate(values)])  # + 0.0: no negative zero
    found = numbers.approxQuantile([f"_v{k}" for k in ks], [i / 1_000 for i in range(1_001)], 0.001)  # of numbers only
    splits = [_splits(q) for q in found]
    coded = Bucketizer(splitsArray=splits, inputCols=[f"_v{k}" for k in ks], outputCols=[f"_i{k}" for k in ks], handleInvalid="keep").transform(numbers)
    items = F.array(*[F.struct(F.lit(k).alias("_f"), F.col(f"_i{k}").cast("int").alias("_i")) for k in ks])
    long = coded.select(F.explode(items).alias("x")).select("x.*").where("_i IS NOT NULL")
    # a few thousand counts for each column: ranks of the values that are intervals, and for the others how many rows lie below
    known, below = ([[None] * len(s) for s in splits] for _ in range(2))
    for c in placed(long, ["_f"], "_i").collect():
        s, k = splits[c["_f"]], c["_i"]
        if k == len(s) - 1 or k < len(s) - 2 and math.nextafter(s[k], math.inf) == s[k + 1]:  # the last are those that are not a number; the one before has infinity too
            known[c["_f"]][k] = c.before + (c.n + 1) / 2.0
        else:
            below[c["_f"]][k] = float(c.before)
    lists = pa.list_(pa.list_(pa.float64()))
    counts = df.sparkSession.createDataFrame(pa.table({"_known": pa.array([known], lists), "_below": pa.array([below], lists)}))
    ranks, code = [v + suffix for v in values], lambda k: F.col(f"_i{k}").cast("int")
    sure = [F.col("_known")[k][code(k)] for k in ks]
    rest = F.array(*[F.when(r.isNull() & F.col(f"_v{k}").isNotNull(), F.struct(F.lit(k).alias("_f"), code(k).alias("_i"), F.col(f"_v{k}").alias("_v"))) for k, r in enumerate(sure)])
    wide = coded.crossJoin(F.broadcast(counts)).select("_row", *[r.alias(name) for r, name in zip(sure, ranks, strict=True)], F.array_compact(rest).alias("_rest"))
    shuffled = wide.select("_row", (F.size("_rest") > 1).alias("_several"), *ranks, F.posexplode("_rest").alias("_at", "x")).select("_row", "_several", *[F.when(F.col("_at") == 0, F.col(r)).alias(r) for r in ranks], "x.*")
    inside = F.rank().over(W.partitionBy("_f", "_i").orderBy("_v")) + (F.count(F.lit(1)).over(W.partitionBy("_f", "_i", "_v")) - 1) / 2.0
    placed_in = shuffled.withColumn("_r", inside).crossJoin(F.broadcast(counts)).withColumn("_r", F.col("_below")[F.col("_f")][F.col("_i")] + F.col("_r"))
    done = checkpointed(placed_in.select("_row", "_several", *[F.coalesce(F.col(r), F.when(F.col("_f") == k, F.col("_r"))).alias(r) for k, r in enumerate(ranks)]))
    none = wide.where((F.size("_rest") == 0) & F.coalesce(*ranks).isNotNull()).select("_row", *ranks)
    one = done.where("NOT _several").select("_row", *ranks)
    met = done.where("_several").groupBy("_row").agg(*[F.max(r).alias(r) for r in ranks])
    return table, none.unionByName(one).unionByName(met)


def ranked(df: DataFrame, values: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """df with the average rank of each value column, as in `rank_rows`."""
    table, ranks = rank_rows(df, values, suffix)
    return table.join(ranks, "_row", "left").drop("_row")


def percentile_rank(value: str, lower_is_better: bool = False) -> Column:
    """Average rank over the number of rows; for lower-is-better 1 - r + 1/n."""
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    r = average_rank(value) / n
    return 1 - r + 1.0 / n if lower_is_better else r


def wilson_interval(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score bounds at 95 %; null where the total is not positive."""
    if confidence != 0.95:
        raise ValueError("only the 95 % interval is supported")
    n = F.when(total > 0, total.cast("double"))
    p, z2 = successes / n, Z_95 * Z_95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z_95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


def chi_square_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution by its closed forms for even and odd degrees of freedom."""
    if dof < 1:
        return 1.0
    h = x / 2
    if dof % 2 == 0:
        return math.exp(-h) * sum(h**i / math.factorial(i) for i in range(dof // 2))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (i + 0.5) / math.gamma(i + 1.5) for i in range((dof - 1) // 2))


def pairs(n: Column) -> Column:
    """n choose 2."""
    return n * (n - 1) / 2.0
