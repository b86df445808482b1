"""HDBSCAN over tables of any size: spanning tree, tree of merges and condensed tree are DataFrames.

* The spanning tree of mutual-reachability distances grows in rounds: every group takes its least edge to another group, by (distance,
  lesser point, greater point), so the tree is one tree whatever the order. A neighbour found once stays the nearest until its group is joined,
  and what a point found before bounds what it can find later; only points that can still hold their group's least edge search again (`voronoi`).
* The tree of merges needs the edges in order. Segments of the order are halved: edges of the lower half are united, which gives the
  vertices of the upper half with their sizes, and both halves go on by themselves. Segments of at most SEGMENT edges are merged one by one in a
  task. So the rounds are the logarithm of the edges, and no task sees more than a segment.
* Nodes of min_cluster_size points or more form chains between true splits; a chain is a cluster. Sums over chains give stabilities.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions.quantiles import cut
from kinetra.operators.dbscan import components, numbered
from kinetra.operators.voronoi import nearest_join

#: Edges that one task merges.
SEGMENT = 1 << 17
#: Clusters of a condensed tree that the driver walks; more are valued in rounds.
FEW_CLUSTERS = 50_000
#: The density of points at distance 0.
DENSEST = 1e12


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def spanning_tree(rows: DataFrame, min_samples: int) -> DataFrame:
    """(h, a, b), a < b: the tree of least mutual-reachability distances of rows (x, v); x is distinct. Equal rows hang on the least of them."""
    equal = cut(rows.groupBy("v").agg(F.min("x").alias("q"), F.count(F.lit(1)).alias("m")))
    places = equal.select("q", "v", F.lit(0.0).alias("w"), F.col("q").alias("c"), "m")
    reach = nearest_join(places, places, max(1, min(min_samples, rows.count())))
    points = cut(equal.join(reach.select("q", F.col("distance").alias("w")), "q").select("q", "v", "w", F.col("q").alias("c"), "m"))
    star = rows.join(points.select("v", "q", "w"), "v").where("x <> q").select(F.col("w").alias("h"), F.col("q").alias("a"), F.col("x").alias("b"))
    edges, near = [cut(star)], None
    while True:
        group = points.select("q", "c")
        other = group.select(F.col("q").alias("p"), F.col("c").alias("d"))
        if near is None:
            near = cut(nearest_join(points, points, 1, "reach").withColumn("valid", F.lit(True)))
        else:
            seen = near.drop("valid").join(group, "q").join(other, "p").withColumn("valid", F.col("c") != F.col("d"))
            best = seen.where("valid").groupBy("c").agg(F.min("distance").alias("best"))
            ask = ~F.col("valid") & (F.col("best").isNull() | (F.col("distance") <= F.col("best")))
            judged = cut(seen.join(best, "c", "left").select("q", "distance", "p", "valid", ask.alias("ask")))
            again = nearest_join(points.join(judged.where("ask").select("q"), "q"), points, 1, "reach")
            near = cut(judged.where("NOT ask").drop("ask").unionByName(again.withColumn("valid", F.lit(True))))
        least = F.min(F.struct(F.col("distance").alias("h"), F.least("q", "p").alias("a"), F.greatest("q", "p").alias("b"), "d")).alias("e")
        taken = cut(near.where("valid").join(group, "q").join(other, "p").groupBy("c").agg(least).select("c", "e.*"))
        if not taken.limit(1).count():
            return reduce(DataFrame.unionByName, edges)
        edges.append(taken.select("h", "a", "b").distinct())
        groups = taken.select(F.col("c").alias("cell"), F.col("c").alias("root"))
        joined = components(groups, _both(taken.select(F.col("c").alias("a"), F.col("d").alias("b"))))
        points = cut(points.join(joined.select(F.col("cell").alias("c"), "root"), "c").select("q", "v", "w", F.col("root").alias("c"), "m"))


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The merges of one segment, in order; size and top of both sides of an edge are those at the segment's start."""
    pdf, up, state, out = pdf.sort_values("k"), {}, {}, []

    def find(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for e in pdf.itertuples(index=False):
        for v, size, top in ((e.a, e.sa, e.ta), (e.b, e.sb, e.tb)):
            if v not in up:
                up[v], state[v] = v, (size, top)
        a, b = find(e.a), find(e.b)
        (sa, ta), (sb, tb) = state[a], state[b]
        out.append((e.node, e.h, ta, sa, tb, sb))
        if sa < sb:
            a, b = b, a
        up[b], state[a] = a, (sa + sb, e.node)
    return pd.DataFrame(out, columns=["node", "h", "l", "ls", "r", "rs"])


def merge_tree(edges: DataFrame) -> DataFrame:
    """(node, h, l, ls, r, rs): the merges of a spanning tree (h, a, b) over points 0 to n - 1, in the order (h, a, b); nodes are numbered from n, l and r are points or nodes, ls and rs their points."""
    ordered = numbered(edges.select(F.struct("h", "a", "b").alias("e")), "e", "k", "long").select("k", "e.*")
    m = ordered.count()
    edges = cut(ordered.select(F.lit(0).cast("long").alias("seg"), "k", (F.col("k") + m + 1).alias("node"), "h", "a", "b"))
    vertices = edges.select("seg", F.explode(F.array("a", "b")).alias("v")).distinct().select("seg", "v", F.lit(1).cast("long").alias("size"), F.col("v").alias("top"))
    shift = max(m - 1, 0).bit_length()
    while (1 << shift) > SEGMENT:
        shift -= 1
        upper = F.shiftright("k", shift).bitwiseAND(F.lit(1).cast("long")) == 1
        low = edges.where(~upper)
        cell = lambda v: F.struct("seg", F.col(v).alias("v"))
        cells = low.select("seg", F.explode(F.array("a", "b")).alias("v")).distinct().select(cell("v").alias("cell"), cell("v").alias("root"))
        united = components(cells, _both(low.select(cell("a").alias("a"), cell("b").alias("b"))))
        names = cut(united.select("cell.seg", "cell.v", F.col("root.v").alias("to")))
        last = low.join(names.withColumnRenamed("v", "a"), ["seg", "a"]).groupBy("seg", "to").agg(F.max("node").alias("top"))
        sizes = vertices.join(names, ["seg", "v"]).groupBy("seg", "to").agg(F.sum("size").alias("size")).join(last, ["seg", "to"])
        whole = vertices.join(names, ["seg", "v"], "left_anti").unionByName(sizes.withColumnRenamed("to", "v"))
        high = edges.where(upper)
        for side in "ab":
            to = names.select("seg", F.col("v").alias(side), "to")
            high = high.join(to, ["seg", side], "left").withColumn(side, F.coalesce("to", side)).drop("to")
        twice = F.col("seg") * 2
        halves = cut(low.withColumn("seg", twice).unionByName(high.withColumn("seg", twice + 1)))
        used = halves.select("seg", F.explode(F.array("a", "b")).alias("v")).distinct()
        known = vertices.withColumn("seg", twice).unionByName(whole.withColumn("seg", twice + 1))
        edges, vertices = halves, cut(known.join(used, ["seg", "v"]))
    for side in "ab":
        edges = edges.join(vertices.select("seg", F.col("v").alias(side), F.col("size").alias(f"s{side}"), F.col("top").alias(f"t{side}")), ["seg", side])
    return edges.groupBy("seg").applyInPandas(_merged, "node long, h double, l long, ls long, r long, rs long")  # at most SEGMENT edges


def _valued_few(clusters: DataFrame) -> DataFrame:
    """`_valued` for at most FEW_CLUSTERS clusters, on the driver. A parent's number is above its children's."""
    rows = sorted((r.cluster, r.parent, r.stability) for r in clusters.collect())
    below: dict[int, float] = {}
    chosen, final = set(), {}
    for c, parent, stability in rows:
        under = below.get(c, 0.0)
        if stability >= under:
            chosen.add(c)
        below[parent] = below.get(parent, 0.0) + max(stability, under)
    for c, parent, _ in reversed(rows):
        over = None if parent is None else final.get(parent)
        final[c] = over if over is not None or parent is None or c not in chosen else c
    return clusters.sparkSession.createDataFrame(list(final.items()), "cluster long, final long")


def _valued(clusters: DataFrame) -> DataFrame:
    """(cluster, final): the chosen cluster that a cluster of (cluster, parent, stability) is or lies in, else null. Chosen is what is as stable as all below together; the root never is."""
    if clusters.limit(FEW_CLUSTERS + 1).count() <= FEW_CLUSTERS:
        return _valued_few(clusters)
    inner = clusters.select(F.col("parent").alias("cluster")).where("cluster IS NOT NULL").distinct()
    done = cut(clusters.join(inner, "cluster", "left_anti").select("cluster", "parent", F.col("stability").alias("value"), F.lit(True).alias("chosen")))
    front = done
    while front.limit(1).count():  # a round for each level from the leaves
        sums = done.groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("under")).where("n = 2")
        ready = clusters.join(sums, "cluster").join(done.select("cluster"), "cluster", "left_anti")
        front = cut(ready.select("cluster", "parent", F.greatest("stability", "under").alias("value"), (F.col("stability") >= F.col("under")).alias("chosen")))
        done = cut(done.unionByName(front))
    front = done.where("parent IS NULL").select("cluster", F.lit(None).cast("long").alias("final"))
    layers = []
    while front.limit(1).count():  # and one from the root
        layers.append(front)
        over = front.select(F.col("cluster").alias("parent"), F.col("final").alias("over"))
        front = cut(done.join(over, "parent").select("cluster", F.coalesce("over", F.when(F.col("chosen"), F.col("cluster"))).alias("final")))
    return reduce(DataFrame.unionByName, layers)


def condensed(nodes: DataFrame, n: int, min_cluster_size: int) -> DataFrame:
    """(x, final): the cluster of each of n points that is no noise, by the stabilities of the condensed tree of `merge_tree`'s nodes."""
    size = min_cluster_size
    left, right = F.col("ls") >= size, F.col("rs") >= size
    spark = nodes.sparkSession
    children = nodes.select("node", F.explode(F.array(F.struct(F.col("l").alias("child"), F.col("ls").alias("n")), F.struct(F.col("r").alias("child"), F.col("rs").alias("n")))).alias("c")).select("node", "c.*")
    few = children.where(F.col("n") < size).select(F.col("node").alias("a"), F.col("child").alias("b"))
    every = spark.range(2 * n - 1).select(F.col("id").alias("cell"), (-F.col("id")).alias("root"))
    out = components(every, _both(few)).where(F.col("cell") < n).select(F.col("cell").alias("x"), (-F.col("root")).alias("node"))
    here = F.col("ls") + F.col("rs")
    leaving = F.when(left & right, here).otherwise(F.when(left, 0).otherwise(F.col("ls")) + F.when(right, 0).otherwise(F.col("rs")))
    density = F.when(F.col("h") > 0, 1 / F.col("h")).otherwise(F.lit(DENSEST))
    big = cut(nodes.where(here >= size).select("node", "l", "r", left.alias("bl"), right.alias("br"), density.alias("density"), leaving.alias("leaving")))
    chain = big.where("bl <> br").select(F.col("node").alias("a"), F.when(F.col("bl"), F.col("l")).otherwise(F.col("r")).alias("b"))
    tops = components(big.select(F.col("node").alias("cell"), (-F.col("node")).alias("root")), _both(chain)).select(F.col("cell").alias("node"), (-F.col("root")).alias("cluster"))
    big = cut(big.join(tops, "node"))
    births = big.where("bl AND br").select(F.explode(F.array("l", "r")).alias("cluster"), F.col("cluster").alias("parent"), F.col("density").alias("birth"))
    lived = (F.col("density") - F.coalesce("birth", F.lit(0.0))) * F.col("leaving")
    clusters = cut(big.join(births, "cluster", "left").groupBy("cluster").agg(F.min("parent").alias("parent"), F.sum(lived).alias("stability")))
    final = _valued(clusters).where("final IS NOT NULL")
    return out.join(big.select("node", "cluster"), "node").join(final, "cluster").select("x", "final")


def hdbscan(points: DataFrame, id_col: str, columns: Sequence[str], min_cluster_size: int, min_samples: int) -> DataFrame:
    """(id, label): clusters of greatest stability, numbered from 0 by their least id; -1 is noise, as are rows with a null or NaN coordinate. Ids are distinct.

    A point counts among its own min_samples; equal rows count each. The whole set is no cluster, so a table without a true split is all noise.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    x = [F.col(c).cast("double") for c in columns]
    present = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in x])
    ids = points.select(F.col(id_col).cast("long").alias("i"), F.when(present, F.array(*x)).alias("v"))
    rows = cut(numbered(ids.where("v IS NOT NULL"), "i", "x", "long"))
    n = rows.count()
    if n < min_cluster_size:
        return ids.select(F.col("i").alias(id_col), F.lit(-1).alias("label"))
    nodes = cut(merge_tree(spanning_tree(rows.select("x", "v"), min_samples)))
    found = cut(condensed(nodes, n, min_cluster_size))
    names = numbered(found.groupBy("final").agg(F.min("x").alias("first")), "first", "label").select("final", "label")
    labels = rows.select("i", "x").join(found, "x").join(names, "final").select("i", "label")
    return ids.select("i").join(labels, "i", "left").select(F.col("i").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))
