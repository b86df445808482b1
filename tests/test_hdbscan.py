"""HDBSCAN as DataFrames against a plain version that holds everything in memory."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import hdbscan as h


def plain(x, min_cluster_size, min_samples):
    """Labels by HDBSCAN over all pairs: Kruskal's tree by (distance, lesser row, greater row), binary merges, condensed tree, greatest stability."""
    n = len(x)
    d = np.array([np.sqrt(np.add.reduce([(x[:, k] - r[k]) ** 2 for k in range(x.shape[1])])) for r in x])
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    first = {}
    for i, r in enumerate(map(tuple, x)):
        first.setdefault(r, i)
    star = [(core[i], first[tuple(r)], i) for i, r in enumerate(x) if first[tuple(r)] != i]
    ones = list(first.values())
    pairs = sorted((max(d[i, j], core[i], core[j]), i, j) for k, i in enumerate(ones) for j in ones[k + 1 :])
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    tree = []
    for w, a, b in pairs:
        if find(a) != find(b):
            root[find(b)] = find(a)
            tree.append((w, a, b))
    tree = sorted(tree + star)
    members, node_of, root = {i: [i] for i in range(n)}, list(range(n)), list(range(n))
    kids, weight = {}, {}
    for k, (w, a, b) in enumerate(tree):
        ra, rb = find(a), find(b)
        kids[n + k], weight[n + k] = (node_of[ra], node_of[rb]), w
        members[n + k] = members[node_of[ra]] + members[node_of[rb]]
        root[rb] = ra
        node_of[ra] = n + k
    labels = np.full(n, -1)

    def visit(node, birth):
        """(stability, [clusters as (own points, clusters inside)]) of the cluster whose top is node."""
        start, total = node, 0.0
        while True:
            lam = 1 / weight[node] if weight[node] > 0 else 1e12
            big = [c for c in kids[node] if len(members[c]) >= min_cluster_size]
            if len(big) == 2:
                total += (lam - birth) * len(members[node])
                inside = [visit(c, lam) for c in big]
                below, chosen = sum(v for v, _ in inside), [c for _, cs in inside for c in cs]
                break
            total += (lam - birth) * sum(len(members[c]) for c in kids[node] if c not in big)
            if not big:
                below, chosen = 0.0, []
                break
            node = big[0]
        return (below, chosen) if start == 2 * n - 2 or total < below else (total, [members[start]])

    if n >= min_cluster_size:
        for k, c in enumerate(sorted(visit(2 * n - 2, 0.0)[1], key=min)):
            labels[c] = k
    return labels.tolist()


def run(spark, x, size, least):
    columns = [f"c{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(i * 3 - 50, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{c} double" for c in columns))
    got = {r.i: r.label for r in h.hdbscan(df.repartition(3), "i", columns, size, least).collect()}
    return [got[i * 3 - 50] for i in range(len(x))]


def blobs(seed, n):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, s, (n, 2)) for c, s in ((0, 0.3), (3, 0.2), (3.9, 0.15), (9, 1.0))] + [rng.uniform(-4, 14, (n // 2, 2))])


def test_labels_are_those_of_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(h, "SEGMENT", 64)
    x = blobs(1, 20)
    want = plain(x, 6, 4)
    assert run(spark, x, 6, 4) == want and max(want) >= 1 and -1 in want


def test_clusters_valued_in_rounds_and_on_the_driver_agree(spark, monkeypatch):
    rows = [(9, None, 1.0), (7, 9, 2.0), (8, 9, 1.0), (5, 8, 3.0), (6, 8, 0.5), (1, 7, 0.5), (2, 7, 1.0)]
    clusters = spark.createDataFrame(rows, "cluster long, parent long, stability double")
    want = {9: None, 7: 7, 1: 7, 2: 7, 8: None, 5: 5, 6: 6}
    assert dict(map(tuple, h._valued(clusters).collect())) == want
    monkeypatch.setattr(h, "FEW_CLUSTERS", 0)
    assert dict(map(tuple, h._valued(clusters).collect())) == want


def test_merges_of_a_chain_in_halves(spark, monkeypatch):
    monkeypatch.setattr(h, "SEGMENT", 16)
    rng = np.random.default_rng(3)
    n = 70
    edges = [(float(rng.integers(0, 9)), int(rng.integers(0, b)), b) for b in range(1, n)]
    got = sorted(tuple(r) for r in h.merge_tree(spark.createDataFrame(edges, "h double, a long, b long")).collect())
    size, top, root, want = [1] * n, list(range(n)), list(range(n)), []

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, (w, a, b) in enumerate(sorted(edges)):
        a, b = find(a), find(b)
        want.append((n + k, w, {(top[a], size[a]), (top[b], size[b])}))
        root[b], size[a], top[a] = a, size[a] + size[b], n + k
    assert [(r[0], r[1], {(r[2], r[3]), (r[4], r[5])}) for r in got] == want


def test_query_labels_a_table_over_the_limit_of_one_task(spark, monkeypatch):
    from kinetra.operators import density
    from kinetra.plans import modelling

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, s, (60, 4)) for c, s in ((0, 0.3), (3, 0.2), (9, 1.0))])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "vec_id long, d0 double, d1 double, d2 double, d3 double")
    monkeypatch.setattr(modelling, "vectors", lambda *_: rows)
    want = plain(x, 15, 5)
    assert max(want) >= 1
    for limit in (1_000, 100):
        monkeypatch.setattr(density, "MAX_SAMPLE", limit)
        got = {r.vec_id: r.label for r in modelling.hdbscan_clusters(spark, "").collect()}
        assert [got[i] for i in range(len(x))] == want


def test_small_empty_and_unplaced_tables(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, math.nan)], "i long, a double")
    assert {tuple(r) for r in h.hdbscan(df, "i", ["a"], 2, 1).collect()} == {(1, -1), (2, -1), (3, -1)}
    assert h.hdbscan(df.limit(0), "i", ["a"], 2, 1).count() == 0
    two = spark.range(30).select(F.col("id").alias("i"), (F.col("id") % 2).cast("double").alias("a"))
    assert {(r.i % 2, r.label) for r in h.hdbscan(two, "i", ["a"], 5, 3).collect()} == {(0, 0), (1, 1)}
    with pytest.raises(ValueError):
        h.hdbscan(df, "i", ["a"], 1, 1)
