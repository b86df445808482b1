"""Operators on every row: nothing is cut by the size of the input."""

import numpy as np
import pytest

from kinetra.functions import quantiles
from kinetra.operators import density, partition
from kinetra.plans import modelling


def test_silhouette_exact_takes_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 12_000
    label = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 4)) + label[:, None]
    df = spark.createDataFrame([(k, int(c), *map(float, v)) for k, (c, v) in enumerate(zip(label, x, strict=True))], "vec_id long, label long, d0 double, d1 double, d2 double, d3 double")
    total = 0.0
    for at in range(0, n, 1_000):
        d = np.sqrt(((x[at : at + 1_000, None] - x[None]) ** 2).sum(axis=2))
        sums = np.stack([d[:, label == c].sum(axis=1) for c in range(3)], axis=1)
        sizes, own = np.bincount(label), label[at : at + 1_000]
        mean = sums / sizes
        a = sums[np.arange(len(own)), own] / (sizes[own] - 1)
        mean[np.arange(len(own)), own] = np.inf
        b = mean.min(axis=1)
        total += ((b - a) / np.maximum(a, b)).sum()
    monkeypatch.setattr(modelling, "vectors", lambda *_: df)
    assert modelling.silhouette_exact(spark, "").first().silhouette == pytest.approx(total / n, abs=1e-6)
    small = df.where("vec_id < 400")
    sampled = partition.silhouette(small, "vec_id", ["d0", "d1", "d2", "d3"]).first().silhouette
    assert sampled == pytest.approx(partition.silhouette_all(small, "vec_id", ["d0", "d1", "d2", "d3"]).first().silhouette)
    few = spark.createDataFrame([(0, 0, 0.0), (1, 1, 1.0)], "vec_id long, label long, d double")
    assert partition.silhouette_all(few, "vec_id", ["d"]).first().silhouette is None


def test_dbscan_settles_or_raises(spark):
    order = [0, *(x for k in range(1, 9) for x in (100 - k, 50 - k))]  # local minima along a chain
    df = spark.createDataFrame([(i, float(at)) for at, i in enumerate(order)] + [(200 + k, 100.0 + k / 10) for k in range(3)], "i long, a double")
    with pytest.raises(RuntimeError):
        density.dbscan(df, "i", ["a"], 1.0, 2, max_rounds=1)
    got = {r.i: r.label for r in density.dbscan(df, "i", ["a"], 1.0, 2).collect()}
    assert {got[i] for i in order} == {0} and {got[200 + k] for k in range(3)} == {1}


def test_numbered_is_the_order_over_partitions(spark):
    values = [int(v) for v in np.random.default_rng(4).permutation(5_000) * 7]
    df = spark.createDataFrame([(v,) for v in values], "root long").repartition(7)
    assert {r.root: r.label for r in density.numbered(df, "root", "label").collect()} == {v: v // 7 for v in values}
    assert density.numbered(df.limit(0), "root", "label").count() == 0


def test_ward_labels_all_rows_and_hdbscan_does_or_raises(spark, monkeypatch):
    rows = spark.range(1_200).selectExpr("id AS vec_id", "(id % 4) * 10 + rand(1) AS d0", "rand(2) AS d1", "rand(3) AS d2", "rand(4) AS d3").persist()
    monkeypatch.setattr(modelling, "vectors", lambda *_: rows)
    for f in (modelling.ward_clusters, modelling.hdbscan_clusters):
        got = {r.vec_id: r.label for r in f(spark, "").collect()}
        assert set(got) == set(range(1_200)) and all(len({got[i] for i in range(k, 1_200, 4)} - {-1}) == 1 for k in range(4))
    many = spark.range(density.MAX_SAMPLE + 1).selectExpr("id AS vec_id", "0.0 AS d0", "0.0 AS d1", "0.0 AS d2", "0.0 AS d3")
    monkeypatch.setattr(modelling, "vectors", lambda *_: many)
    with pytest.raises(ValueError):
        modelling.hdbscan_clusters(spark, "")
    assert modelling.ward_clusters(spark, "").where("label = 0").count() < density.MAX_SAMPLE + 1


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if rng.random() < 0.1 else float(rng.integers(0, 30)), float(rng.normal())) for g in ("a", "b", None) for _ in range(157)] + [("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, u double, v double").repartition(5)
    percents = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {(r.g, r.feature): list(r.q) for r in quantiles.quantiles(df, ["u", "v"], percents, ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        for k, f in ((1, "u"), (2, "v")):
            x = [r[k] for r in rows if r[0] == g and r[k] is not None]
            assert got.pop((g, f), None) == (pytest.approx(np.quantile(x, percents).tolist()) if x else None)
    assert not got
    everything = quantiles.percentiles(df, ["v"], (0.5,))
    assert everything["v"][0] == pytest.approx(float(np.median([r[2] for r in rows])))
    assert quantiles.percentiles(df.limit(0), ["v"], (0.5,)) == {} and quantiles.medians(df, ["g"], ["u"]).count() == 3
