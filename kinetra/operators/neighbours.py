"""Nearest neighbours by Euclidean distance and the Hopkins statistic.

A bounded query set (`nearest`) is broadcast as one matrix and compared with every partition of the table in numpy, keeping k candidates for
each query before the shuffle. Query sets without a bound (`kth_distance`) go through the Voronoi cells of `voronoi`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.operators.voronoi import kth_distances

MAX_QUERIES = 20_000


def nearest(points: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, include_self: bool = True) -> DataFrame:
    """(query, neighbour, distance, rank 1..k) for each query id; at most MAX_QUERIES queries."""
    rows = queries.select(id_col, vector_col).limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"over {MAX_QUERIES} queries: pass a sample")
    if not rows:
        return points.sparkSession.createDataFrame([], "query long, neighbour long, distance double, rank int")
    sent = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([list(r[1]) for r in rows], dtype=float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                x = np.array(part.v.tolist(), dtype=float)
                pid = part.i.to_numpy()
                d = np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in q])
                if not include_self:
                    d[ids[:, None] == pid[None, :]] = np.inf
                keep = min(k, d.shape[1])
                at = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                edge = np.take_along_axis(d, at, 1).max(axis=1)
                qi, pj = np.nonzero(d <= edge[:, None])  # ties at the edge stay, so that they break by id
                ok = np.isfinite(d[qi, pj])
                yield pd.DataFrame({"query": ids[qi][ok], "neighbour": pid[pj][ok], "distance": d[qi, pj][ok]})

    near = points.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(run, "query long, neighbour long, distance double")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def kth_distance(points: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(query, distance) of each query row, however many there are, to its k-th neighbour among all points, itself being the first: each visits only the cells that it must."""
    return kth_distances(points, queries, id_col, vector_col, k).select(F.col(id_col).alias("query"), "distance")


def hopkins(points: DataFrame, id_col: str, columns: Sequence[str], sample: int = 1_000, seed: int = 100) -> float:
    """Sum of distances from uniform points to their nearest row, over that plus the distances of sampled rows to their second nearest; 0.5 if both are 0."""
    n = points.count()
    if n < 3:
        raise ValueError("at least three rows are needed")
    m = min(sample, max(2, n - 1))
    box = points.agg(*[F.min(c).alias(f"{c}__lo") for c in columns], *[F.max(c).alias(f"{c}__hi") for c in columns]).first()
    rng = np.random.default_rng(seed)
    lo, hi = np.array([box[f"{c}__lo"] for c in columns], dtype=float), np.array([box[f"{c}__hi"] for c in columns], dtype=float)
    spark = points.sparkSession
    vectors = points.select(F.col(id_col).cast("long").alias("i"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    uniform = spark.createDataFrame([(-1 - k, [float(x) for x in row]) for k, row in enumerate(rng.uniform(lo, hi, (m, len(columns))))], "i long, v array<double>")
    drawn = vectors.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(m)
    u = nearest(vectors, uniform, "i", "v", 1).agg(F.sum("distance")).first()[0] or 0.0
    w = nearest(vectors, drawn, "i", "v", 2).where("rank = 2").agg(F.sum("distance")).first()[0] or 0.0
    return 0.5 if u + w == 0 else u / (u + w)
