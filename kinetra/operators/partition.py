"""Quality and agreement of partitions (label -1 is noise)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.functions.quantiles import medians, percentiles
from kinetra.functions.stats import pairs

#: Rows that `silhouette_all` sends to every task, and labels whose sums a task of it holds at once.
SENT_ROWS, MOST_LABELS = 1_000_000, 256


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: rows, clustered rows, coverage, noise share, clusters, least and largest size and their share of all rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    real = F.col(label) >= 0
    n = F.sum("c")
    k = F.sum(F.when(real, F.col("c")))
    return counts.agg(n.alias("n"), F.coalesce(k, F.lit(0)).alias("n_clustered"), (100.0 * F.coalesce(k, F.lit(0)) / n).alias("coverage_pct"), (100.0 * (n - F.coalesce(k, F.lit(0))) / n).alias("noise_pct"), F.count_if(real).alias("n_clusters"), F.min(F.when(real, F.col("c"))).alias("min_size"), F.max(F.when(real, F.col("c"))).alias("max_size"), (100.0 * F.min(F.when(real, F.col("c"))) / n).alias("min_pct"), (100.0 * F.max(F.when(real, F.col("c"))) / n).alias("max_pct"))


def centroids(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    return df.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"{c}__c") for c in columns])


def davies_bouldin_calinski(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """One row (davies_bouldin, calinski_harabasz), both null with fewer than two clusters or as many clusters as rows.

    The pair join is among clusters (a bounded number), not rows.
    """
    real = df.where(F.col(label) >= 0).select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(c) for c in columns])
    cent = centroids(real, columns)
    sq = sum(((F.col(c) - F.col(f"{c}__c")) * (F.col(c) - F.col(f"{c}__c")) for c in columns), F.lit(0.0))
    spread = real.join(cent, "label").withColumn("sq", sq).groupBy("label").agg(F.first("size").alias("size"), F.avg(F.sqrt("sq")).alias("s"), F.sum("sq").alias("within"), *[F.first(f"{c}__c").alias(f"{c}__c") for c in columns])
    a, b = spread.alias("a"), spread.alias("b")
    gap = F.sqrt(sum((((F.col(f"a.{c}__c") - F.col(f"b.{c}__c")) * (F.col(f"a.{c}__c") - F.col(f"b.{c}__c"))) for c in columns), F.lit(0.0)))
    worst = a.join(F.broadcast(b), F.col("a.label") != F.col("b.label")).groupBy("a.label").agg(F.max(F.try_divide(F.col("a.s") + F.col("b.s"), gap)).alias("r"))
    n, k = F.sum("size"), F.count(F.lit(1))
    grand = {c: F.sum(F.col("size") * F.col(f"{c}__c")) / n for c in columns}
    between = sum((F.sum(F.col("size") * F.col(f"{c}__c") * F.col(f"{c}__c")) - n * grand[c] * grand[c] for c in columns), F.lit(0.0))
    ch = spread.agg(n.alias("n"), k.alias("k"), between.alias("between"), F.sum("within").alias("w"))
    valid = (F.col("k") > 1) & (F.col("n") > F.col("k"))
    return ch.join(F.broadcast(worst.agg(F.avg("r").alias("db")))).select(F.when(valid, F.col("db")).alias("davies_bouldin"), F.when(valid, F.try_divide(F.col("between") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def silhouette(df: DataFrame, id_col: str, columns: Sequence[str], label: str = "label", sample: int = 5_000, seed: int = 42) -> DataFrame:
    """One row (silhouette): mean over a stated sample, Euclidean, the sample against itself in broadcast blocks as the measure is defined.

    A sample covers all rows where there are no more than `sample`.
    """
    import numpy as np
    import pandas as pd

    real = df.where(F.col(label) >= 0).select(F.col(id_col).cast("string").alias("i"), F.col(label).cast("long").alias("label"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    drawn = real.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(sample)
    rows = drawn.collect()
    spark = df.sparkSession
    labels = np.array([r.label for r in rows])
    if len(set(labels.tolist())) < 2 or len(rows) <= len(set(labels.tolist())):
        return spark.createDataFrame([(None,)], "silhouette double")
    sent = spark.sparkContext.broadcast((labels, np.array([r.v for r in rows])))

    def run(batches):
        labels_, x = sent.value
        names, at = np.unique(labels_, return_inverse=True)
        sizes = np.bincount(at)
        member = np.eye(len(names))[at]
        for pdf in batches:
            v, own = np.array(pdf.v.tolist(), dtype=float), np.searchsorted(names, pdf.label.to_numpy())
            for lo in range(0, len(v), 256):
                part, mine = v[lo : lo + 256], own[lo : lo + 256]
                sums = np.sqrt(sum((part[:, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1]))) @ member
                each = np.arange(len(part))
                inner = sums[each, mine] / np.maximum(sizes[mine] - 1, 1)
                other = sums / sizes
                other[each, mine] = np.inf
                outer = other.min(axis=1)
                top = np.maximum(inner, outer)
                yield pd.DataFrame({"s": np.where((sizes[mine] == 1) | (top == 0), 0.0, (outer - inner) / np.where(top == 0, 1.0, top))})

    parts = spark.createDataFrame(rows, real.schema).repartition(8)
    return parts.mapInPandas(run, "s double").agg(F.avg("s").alias("silhouette"))


def silhouette_all(df: DataFrame, id_col: str, columns: Sequence[str], label: str = "label", block_rows: int = 2_048) -> DataFrame:
    """One row (silhouette): mean over all clustered rows, Euclidean, every row against all rows; null as in `silhouette`.

    Rows are packed into blocks by hash. A task adds up the distances of its block to each cluster over all the blocks it meets: where
    the other side is sent to every task these sums are whole, and only a row for each id is shuffled.
    """
    import numpy as np
    import pandas as pd

    real = df.where(F.col(label) >= 0).select(F.col(id_col).cast("string").alias("i"), F.col(label).cast("long").alias("label"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    found = real.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("labels")).first()
    n_blocks = max(1, -(-found.rows // block_rows))
    packed = real.groupBy(F.pmod(F.xxhash64("i"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(F.struct("i", "label", "v")).alias("rows"))
    left = packed.select("b", F.col("rows.i").alias("i"), F.col("rows.label").alias("la"), F.flatten("rows.v").alias("va")).repartition(n_blocks)
    right = packed.select(F.col("rows.label").alias("lb"), F.flatten("rows.v").alias("vb"))
    most_labels, sent = MOST_LABELS, found.rows <= SENT_ROWS  # else a product of partitions
    if sent:
        right = F.broadcast(right)

    def distance_sums(x, y, member):
        """For each row of x the sum of its distances to the rows of y in each column of `member`, in tiles that stay in the processor's cache."""
        sums, step, by_column = np.empty((len(x), member.shape[1])), max(1, 32_768 // len(y)), np.ascontiguousarray(y.T)
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            sq, one = np.zeros((len(part), len(y))), np.empty((len(part), len(y)))
            for c, values in enumerate(by_column):
                np.subtract(part[:, c, None], values, out=one)
                np.add(sq, np.square(one, out=one), out=sq)
            sums[lo : lo + step] = np.sqrt(sq, out=sq) @ member
        return sums

    def tables(keys, _, sums):
        for lb, (s, n) in sums.items():  # rows with the same id and label are one, with the sums of all
            yield keys.assign(lb=lb, s=s, n=n).groupby(["i", "la", "lb"], dropna=False, sort=False, as_index=False).sum(min_count=1)
        sums.clear()

    def run(batches):
        held = {}  # by block of the left side, which a task meets again and again: keys, points and the sums so far
        for pdf in batches:
            for b, i, la, va, lb, vb in zip(pdf.b, pdf.i, pdf.la, pdf.va, pdf.lb, pdf.vb, strict=True):
                if b not in held:
                    held[b] = pd.DataFrame({"i": np.asarray(i, dtype=object), "la": la}), np.array(va, dtype=float).reshape(len(la), -1), {}
                _, x, sums = held[b]
                names, at, sizes = np.unique(lb, return_inverse=True, return_counts=True)
                for k, s, n in zip(names, distance_sums(x, np.array(vb, dtype=float).reshape(len(lb), -1), np.eye(len(names))[at]).T, sizes, strict=True):
                    was, n0 = sums.get(k, (np.nan, 0))
                    sums[k] = np.where(np.isnan(was), s, np.where(np.isnan(s), was, was + s)), n0 + n  # a sum that is not a number is none
                if len(sums) > most_labels:
                    yield from tables(*held[b])
        for one in held.values():
            yield from tables(*one)

    d = left.crossJoin(right).mapInPandas(run, "i string, la long, lb long, s double, n long")
    if not sent or found.labels > most_labels:
        d = d.groupBy("i", "la", "lb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("la") == F.col("lb")
    p = d.groupBy("i", "la").agg(F.max(F.when(own, F.col("n"))).alias("own"), F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    one = p.agg(F.avg(F.when((F.col("own") == 1) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)).alias("s"), F.countDistinct("la").alias("k"), F.count(F.lit(1)).alias("n"))
    return one.select(F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.col("s")).alias("silhouette"))


def normalized_entropy(df: DataFrame, label: str = "label") -> DataFrame:
    """One row (entropy): entropy of cluster shares without noise over its largest value; 0 with one cluster or none."""
    counts = df.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(F.lit(0)))
    return counts.withColumn("p", p).agg(F.count(F.lit(1)).alias("k"), F.sum(-F.col("p") * F.log("p")).alias("h")).select(F.when(F.col("k") > 1, F.col("h") / F.log("k")).otherwise(0.0).alias("entropy"))


def adjusted_rand(table: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two label columns, for each group of `by`; 1 where it is degenerate."""
    by = list(by)
    cells = table.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("c"))
    total = lambda df, n: df.groupBy(*by).agg(F.sum(pairs(F.col("c"))).alias(n))
    rows = total(cells.groupBy(*by, a).agg(F.sum("c").alias("c")), "sa")
    cols = total(cells.groupBy(*by, b).agg(F.sum("c").alias("c")), "sb")
    both = cells.groupBy(*by).agg(F.sum(pairs(F.col("c"))).alias("s"), pairs(F.sum("c")).alias("all"))
    j = both.join(rows, by).join(cols, by) if by else both.join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("all"))
    den = (F.col("sa") + F.col("sb")) / 2.0 - expected
    return j.select(*by, F.when(F.coalesce(den == 0, F.lit(True)), 1.0).otherwise(F.try_divide(F.col("s") - expected, den)).alias("ari"))


def pairwise_stability(runs: DataFrame, id_col: str = "id", run_col: str = "run", label: str = "label") -> DataFrame:
    """One row (mean_ari, min_ari, std_ari) over all pairs of runs; null with fewer than two. Rows are joined on the id, so the join makes runs * (runs - 1) / 2 rows an id."""
    a = runs.select(F.col(id_col).alias("i"), F.col(run_col).alias("ra"), F.col(label).alias("la"))
    b = runs.select(F.col(id_col).alias("i"), F.col(run_col).alias("rb"), F.col(label).alias("lb"))
    scored = adjusted_rand(a.join(b, "i").where("ra < rb"), "la", "lb", ["ra", "rb"])
    return scored.agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"), F.stddev_pop("ari").alias("std_ari"))


def robust_profile_scores(df: DataFrame, group: Sequence[str], features: Sequence[str], noise: int | None = -1) -> DataFrame:
    """(group median - global median) / global IQR, an IQR of 0 counting as 1. Rows whose first group column is `noise` are left out of both."""
    if noise is not None:
        df = df.where(~F.col(group[0]).eqNullSafe(F.lit(noise)))
    overall = percentiles(df, features, (0.25, 0.5, 0.75))
    score = {f: (F.col(f) - F.lit(q[1])) / F.lit(q[2] - q[0] or 1.0) for f, q in overall.items()}
    return medians(df, group, features).select(*group, *[score.get(f, F.lit(None).cast("double")).alias(f) for f in features])
