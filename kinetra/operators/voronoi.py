"""Exact nearest-neighbour joins by a Voronoi partition with triangle-inequality bounds.

At most MAX_PIVOTS rows serve as pivots; each point belongs to the cell of its nearest pivot, and of a cell its radius, size and extremes are known
(a row for each pivot on the driver). A query first looks at its own cell, which bounds what it still seeks; then it visits only the cells
whose points can be nearer, by |query - pivot| less the radius. Cells are cut into parts of about PART_ROWS points and the visitors of a part into
blocks, so a task compares two bounded blocks in numpy, and a hot cell is many pairs of blocks that Spark deals out.

Three distances share the search: `euclid`; `ward`, the increase of the sum of squares when clusters of sizes w merge; and `reach`, the
mutual-reachability distance of points with core distances w. The last two leave out points of the query's own group c.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.functions.quantiles import cut

MAX_PIVOTS = 4_096
PART_ROWS = 1_024
ROW = "q long, v array<double>, w double, c long"


@dataclass
class Cells:
    """What the driver and every task know of the partition: an entry for each pivot."""

    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray  #: points, with their multiplicities
    low: np.ndarray  #: least w
    high: np.ndarray  #: greatest w
    group: np.ndarray  #: the group of all points, or -1 where they differ
    first: np.ndarray  #: the number of the first part; a last entry closes the list


def _matrix(values) -> np.ndarray:
    return np.array(values.tolist(), dtype=float)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, dimension by dimension."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += (x[:, k, None] - y[None, :, k]) ** 2
    return out


def measured(mode: str, d2: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """The distance of the mode from squared Euclidean distances; monotonic in them and in both w."""
    if mode == "euclid":
        return np.sqrt(d2)
    a, b = wx[:, None], wy[None, :]
    return a * b / (a + b) * d2 if mode == "ward" else np.maximum(np.sqrt(d2), np.maximum(a, b))


def _assigned(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1_024):
                part = pdf.iloc[lo : lo + 1_024]
                d2 = squared(_matrix(part.v), sent.value)
                cell = d2.argmin(axis=1)
                yield part.assign(cell=cell, r=np.sqrt(d2[np.arange(len(part)), cell]))

    return points.mapInPandas(run, f"{ROW}, m long, cell int, r double")


def _partition(points: DataFrame, seed: int) -> tuple[DataFrame, Cells] | None:
    """(points with their part, the cells) of points (q, v, w, c, m); None if there are none."""
    n = points.count()
    if not n:
        return None
    wanted = min(MAX_PIVOTS, max(1, math.isqrt(n)))
    pivots = _matrix(pd.Series([r.v for r in points.select("q", "v").orderBy(F.xxhash64("q", F.lit(seed)), "q").limit(wanted).collect()]))
    placed = cut(_assigned(points, pivots))
    rows = placed.groupBy("cell").agg(F.max("r").alias("r"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"), F.min("w").alias("low"), F.max("w").alias("high"), F.min("c").alias("c1"), F.max("c").alias("c2")).collect()  # a row for each pivot at most
    at = [r.cell for r in rows]
    known = {k: np.array([r[k] for r in rows], dtype=float) for k in ("r", "m", "low", "high")}
    parts = np.zeros(len(rows) + 1, dtype=np.int64)
    parts[1:] = np.cumsum([-(-r.n // PART_ROWS) for r in rows])
    cells = Cells(pivots[at], known["r"], known["m"], known["low"], known["high"], np.array([r.c1 if r.c1 == r.c2 else -1 for r in rows]), parts)
    table = F.broadcast(points.sparkSession.createDataFrame([(c, k, int(parts[k]), int(parts[k + 1] - parts[k])) for k, c in enumerate(at)], "cell int, k int, _first long, _parts long"))
    return placed.join(table, "cell").select("q", "v", "w", "c", "m", F.col("k").alias("cell"), (F.col("_first") + F.pmod(F.xxhash64("q"), F.col("_parts"))).alias("part")), cells


def _compare(visits: DataFrame, blocks: DataFrame, k: int, mode: str) -> DataFrame:
    """(q, distance, p, m): for each visit (part, q, v, w, c, limit) the k nearest points of the part, and ties, within the limit."""
    crowd = visits.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    row = F.struct("q", "v", "w", "c", "limit")
    packed = visits.join(crowd, "part").groupBy("part", F.pmod(F.xxhash64("q"), F.ceil(F.col("_n") / PART_ROWS)).alias("_b")).agg(F.collect_list(row).alias("xs"))  # about PART_ROWS visits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True):
                q, x, wx, cx, limit = ([r[f] for r in xs] for f in ("q", "v", "w", "c", "limit"))
                p, y, wy, cy, m = ([r[f] for r in ys] for f in ("q", "v", "w", "c", "m"))
                by = np.argsort(p)  # so that the first of equal distances is the one of the least p
                q, p, m = np.array(q), np.array(p)[by], np.array(m)[by]
                y, wy, cy = np.array(y, dtype=float)[by], np.array(wy)[by], np.array(cy)[by]
                for lo in range(0, len(q), 512):
                    cut = slice(lo, lo + 512)
                    d = measured(mode, squared(np.array(x[cut], dtype=float), y), np.array(wx[cut]), wy)
                    if mode != "euclid":
                        d[np.array(cx[cut])[:, None] == cy[None, :]] = np.inf
                    if k == 1:
                        i, j = np.arange(len(d)), d.argmin(axis=1)
                        good = d[i, j] <= np.minimum(np.array(limit[cut], dtype=float), np.finfo(float).max)
                        yield pd.DataFrame({"q": q[cut][good], "distance": d[i, j][good], "p": p[j[good]], "m": m[j[good]]})
                        continue
                    edge = np.minimum(np.partition(d, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1], np.array(limit[cut], dtype=float))
                    i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                    yield pd.DataFrame({"q": q[cut][i], "distance": d[i, j], "p": p[j], "m": m[j]})

    return packed.select("part", "xs").join(blocks, "part").select("xs", "ys").mapInPandas(run, "q long, distance double, p long, m long")


def nearest_join(queries: DataFrame, points: DataFrame, k: int = 1, mode: str = "euclid", seed: int = 1) -> DataFrame:
    """(q, distance, p): for each query (q, v, w, c) the point p that completes k neighbours among points (q, v, w, c, m), m its multiplicity.

    Neighbours are taken by distance, then p. Queries that find fewer than k have no row; empty tables give none.
    """
    spark = queries.sparkSession
    found = _partition(points, seed)
    if found is None:
        return spark.createDataFrame([], "q long, distance double, p long")
    placed, cells = found
    blocks = cut(placed.groupBy("part").agg(F.collect_list(F.struct("q", "v", "w", "c", "m")).alias("ys")))  # about PART_ROWS points
    sent = spark.sparkContext.broadcast(cells)

    def spread(pdf: pd.DataFrame, chosen: np.ndarray, limit: np.ndarray, cells: Cells) -> pd.DataFrame:
        i, j = np.nonzero(chosen)
        counts = (cells.first[j + 1] - cells.first[j]).astype(int)
        rows = np.repeat(i, counts)
        part = np.repeat(cells.first[j], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        out = pdf.iloc[rows][["q", "v", "w", "c"]]
        return out.assign(limit=limit[rows], part=part)

    def plan(own: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = sent.value
            for whole in batches:
                for lo in range(0, len(whole), 512):
                    pdf = whole.iloc[lo : lo + 512].reset_index(drop=True)
                    d = np.sqrt(squared(_matrix(pdf.v), cells.pivots))
                    at = d.argmin(axis=1)
                    mine = np.zeros(d.shape, dtype=bool)
                    mine[np.arange(len(pdf)), at] = True
                    w, c = pdf.w.to_numpy(dtype=float), pdf.c.to_numpy()
                    other = np.ones(d.shape, dtype=bool) if mode == "euclid" else cells.group[None, :] != c[:, None]
                    reach = np.where(other, measured(mode, (d + cells.radius) ** 2, w, cells.high), np.inf)
                    if mode == "euclid":
                        order = np.argsort(reach, axis=1)
                        enough = (np.cumsum(cells.size[order], axis=1) >= k).argmax(axis=1)
                        most = np.where(cells.size.sum() >= k, np.take_along_axis(reach, order, 1)[np.arange(len(pdf)), enough], np.inf)
                    else:
                        most = reach.min(axis=1)  # a cell that holds another group has a point of it within its radius
                    most = most * (1 + 1e-9)  # bounds are sums in another order than distances
                    if own:
                        yield spread(pdf, mine & other, most, cells)
                        continue
                    most = np.minimum(most, np.where(np.isnan(pdf.bound), np.inf, pdf.bound.to_numpy(dtype=float)))
                    least = measured(mode, np.maximum(d * (1 - 1e-9) - cells.radius, 0.0) ** 2, w, cells.low)
                    yield spread(pdf, other & ~mine & (least <= most[:, None] * (1 + 1e-9)), most, cells)

        return run

    visit = f"{ROW}, limit double, part long"
    queries = cut(queries.select("q", "v", F.col("w").cast("double").alias("w"), F.col("c").cast("long").alias("c")))
    so_far = W.partitionBy("q").orderBy("distance", "p").rowsBetween(W.unboundedPreceding, W.currentRow)
    kth = lambda rows: rows.withColumn("_s", F.sum("m").over(so_far)).where((F.col("_s") >= k) & (F.col("_s") - F.col("m") < k)).select("q", "distance", "p")
    first = cut(_compare(queries.mapInPandas(plan(True), visit), blocks, k, mode))
    bounded = queries.join(kth(first).select("q", F.col("distance").alias("bound")), "q", "left")
    second = _compare(bounded.mapInPandas(plan(False), visit), blocks, k, mode)
    return kth(first.unionByName(second))


def kth_distances(points: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(id, distance) of every row of queries to its k-th nearest row of points. Equal vectors are one point of their multiplicity and one query, so a value that a third of the rows share is searched once."""

    def distinct(table: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = table.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
        return rows, rows.groupBy("v").agg(F.min("_id").alias("q"), F.count(F.lit(1)).alias("m")).select("q", "v", F.lit(0.0).alias("w"), F.col("q").alias("c"), "m")

    rows, asked = distinct(queries)
    asked = cut(asked)
    found = nearest_join(asked, cut(distinct(points)[1]), k)
    return rows.join(asked.select("v", "q"), "v").join(found, "q").select(F.col("_id").alias(id_col), "distance")
