"""DBSCAN on cells against a plain version, and its work in a dense ball."""

import numpy as np
import pytest

from kinetra.operators import dbscan as cells
from kinetra.operators.density import dbscan


def plain(x, eps, least):
    d = np.sqrt(sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(x.shape[1])))
    near = d <= eps
    core = near.sum(axis=1) >= least
    root = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None, :], root[None, :], len(x)).min(axis=1), len(x))
        if (new == root).all():
            break
        root = new
    border = np.where(near & core[None, :], root[None, :], len(x)).min(axis=1)
    root = np.where(core, root, border)
    names = {r: k for k, r in enumerate(sorted(set(root[core].tolist())))}
    return [names.get(r, -1) for r in root.tolist()]


def labels(spark, x, eps, least):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"c{k} double" for k in range(x.shape[1])))
    got = {r.i: r.label for r in dbscan(df.repartition(3), "i", [f"c{k}" for k in range(x.shape[1])], eps, least).collect()}
    return [got[i] for i in range(len(x))]


def made(kind, dims, rng):
    if kind == "blobs":
        return np.vstack([rng.normal(c, 0.3, (60, dims)) for c in (0, 2, 2.9)] + [rng.uniform(-3, 6, (30, dims))])
    if kind == "grid":  # distances of exactly eps
        return np.array([[i, *[j] * (dims - 1)] for i in range(9) for j in (0, 1, 2, 7)], dtype=float)
    if kind == "repeats":
        return np.repeat(rng.normal(0, 2, (12, dims)), 9, axis=0)
    theta = rng.uniform(0, 6.28, 240)  # two thin rings whose cells are crowded and nearly touch
    ring = np.stack([np.cos(theta), np.sin(theta)], axis=1) * np.where(np.arange(240) % 2, 3.0, 3.9)[:, None]
    return np.hstack([ring, rng.normal(0, 0.01, (240, dims - 2))]) if dims > 2 else ring


@pytest.mark.parametrize(("kind", "dims", "eps", "least"), [("blobs", 2, 0.5, 5), ("grid", 2, 1.0, 3), ("repeats", 3, 1.2, 10), ("rings", 2, 0.5, 4), ("rings", 2, 0.905, 40), ("blobs", 4, 0.9, 8)])
def test_cells_label_as_plain_dbscan(spark, monkeypatch, kind, dims, eps, least):
    monkeypatch.setattr(cells, "SMALL_PRODUCT", 4)  # so that parts are halved, too
    if kind == "blobs":
        monkeypatch.setattr(cells, "FEW_LINKS", 0)  # and labels spread in rounds
    x = made(kind, dims, np.random.default_rng(dims))
    assert labels(spark, x, eps, least) == plain(x, eps, least)


def test_open_pairs_are_decided_by_halving(spark, monkeypatch):
    """Two crowded cells whose edge points are far from each other, but whose nearest points are within eps."""
    monkeypatch.setattr(cells, "SMALL_PRODUCT", 4)
    space = cells._Space(2)
    a = [(0.0, 0.0), (0.0, 1.0), (0.4, 0.2), (0.9, 0.5), (0.4, 0.8)]
    b = [(2.8, 0.0), (2.8, 1.0), (1.8, 0.5), (2.5, 0.3), (2.4, 0.6)]
    c = [(0.0, 5.0), (0.0, 5.0), (0.0, 5.0)]
    points = spark.createDataFrame([(n, *p) for n, ps in (("a", a), ("b", b), ("c", c)) for p in ps], "cell string, x0 double, x1 double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    assert [(r.a, r.b) for r in cells._split_links(space, points, pairs, 0.95).collect()] == [("a", "b")]
    assert cells._split_links(space, points, pairs, 0.89).collect() == []


def test_work_in_a_dense_ball_is_linear(spark):
    """Points of one ball of radius eps / 2: no join of point pairs, whatever their number."""
    rng = np.random.default_rng(5)
    for n in (300, 2_400):
        x = rng.normal(0, 1, (n, 2))
        x = 0.05 * x / np.maximum(1, np.sqrt((x**2).sum(axis=1, keepdims=True)))
        assert labels(spark, np.vstack([x, [[9, 9]]]), 0.1, 5) == [0] * n + [-1]


def test_null_coordinates_empty_tables_and_wrong_radius(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, 0.1)], "i long, a double")
    assert {r.i: r.label for r in dbscan(df, "i", ["a"], 0.5, 2).collect()} == {1: 0, 2: -1, 3: 0}
    assert dbscan(df.limit(0), "i", ["a"], 0.5, 2).collect() == []
    with pytest.raises(ValueError, match="eps"):
        dbscan(df, "i", ["a"], 0.0, 2)
