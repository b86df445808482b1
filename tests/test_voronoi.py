"""Nearest-neighbour joins by Voronoi cells against all pairs."""

import numpy as np
import pytest

from kinetra.operators import density, voronoi


def table(spark, x, w=None, c=None, m=None):
    rows = [(k, [float(a) for a in r], float(w[k]) if w is not None else 0.0, int(c[k]) if c is not None else k, int(m[k]) if m is not None else 1) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "q long, v array<double>, w double, c long, m long").repartition(3)


def clouds(n, dims, seed):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.3, (n // 4, dims)) for c in (0, 3, 6, 20)])


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(voronoi, "PART_ROWS", 16)  # so that cells have parts


@pytest.mark.parametrize(("k", "dims"), [(1, 2), (5, 3), (40, 2)])
def test_kth_distances_of_all_rows(spark, small_parts, k, dims):
    x = clouds(320, dims, k)
    x[40:90] = x[0]  # a vector of many rows
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, e array<float>")
    x = x.astype(np.float32).astype(float)
    d = np.sort(np.sqrt(voronoi.squared(x, x)), axis=1)[:, k - 1]
    got = {r.id: r.distance for r in voronoi.kth_distances(df, df, "id", "e", k).collect()}
    assert set(got) == set(range(320)) and np.allclose([got[i] for i in range(320)], d)


@pytest.mark.parametrize("mode", ["ward", "reach"])
def test_nearest_of_another_group(spark, small_parts, mode):
    rng = np.random.default_rng(8)
    x, w = clouds(240, 2, 9), rng.uniform(0.1, 5, 240)
    for c in (np.arange(240), np.arange(240) // 60, np.where(np.arange(240) < 239, 0, 1)):
        d = voronoi.measured(mode, voronoi.squared(x, x), w, w)
        d[c[:, None] == c[None, :]] = np.inf
        df = table(spark, x, w, c)
        got = {r.q: (r.p, r.distance) for r in voronoi.nearest_join(df.drop("m"), df, 1, mode).collect()}
        assert [got[i][0] for i in range(240)] == d.argmin(axis=1).tolist() and np.allclose([got[i][1] for i in range(240)], d.min(axis=1))


def test_bounds_save_most_distances(spark, monkeypatch, tmp_path):
    """Blocks that are compared, counted by files that the tasks leave, hold far fewer pairs than all rows with all rows."""
    x = clouds(4_000, 2, 3)
    df = table(spark, x)
    seen = spark.sparkContext.accumulator(0)
    compare = voronoi._compare

    def counted(visits, blocks, k, mode):
        pairs = visits.join(blocks.selectExpr("part", "size(ys) AS n"), "part").groupBy().sum("n").first()[0] or 0
        seen.add(pairs)
        return compare(visits, blocks, k, mode)

    monkeypatch.setattr(voronoi, "_compare", counted)
    assert voronoi.nearest_join(df.drop("m"), df, 5).count() == 4_000
    assert seen.value < 0.25 * 4_000**2


def test_few_and_no_points(spark):
    df = table(spark, np.array([[0.0], [1.0], [3.0]]))
    assert {(r.q, r.p) for r in voronoi.nearest_join(df.drop("m"), df, 2).collect()} == {(0, 1), (1, 0), (2, 1)}
    assert voronoi.nearest_join(df.drop("m"), df, 4).collect() == [] and voronoi.nearest_join(df.drop("m"), df.limit(0), 1).collect() == []
    assert voronoi.nearest_join(df.limit(0).drop("m"), df, 1).collect() == []
    alone = table(spark, np.array([[0.0], [1.0]]), w=[1, 1], c=[7, 7])
    assert voronoi.nearest_join(alone.drop("m"), alone, 1, "reach").collect() == []


def test_ward_merges_as_in_memory(spark, small_parts, monkeypatch):
    monkeypatch.setattr(density, "WARD_SMALL", 60)
    x = np.random.default_rng(4).normal(0, 1, (260, 2)) * [3, 1]
    x[:80] = x[80]  # one place of many rows
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(900, None, 1.0)], "i long, a double, b double").repartition(3)
    got = {r.i: r.label for r in density.ward(df, "i", ["a", "b"], 5).collect()}
    assert got.pop(900) == -1 and [got[i] for i in range(260)] == density.ward_labels(x, 5).tolist()
    few = df.where("i IN (0, 100, 101)")
    assert [r.label for r in density.ward(few, "i", ["a", "b"], 5).orderBy("i").collect()] == [0, 1, 2]
    assert density.ward(df.limit(0), "i", ["a", "b"], 3).collect() == []


def test_estimates_do_not_grow_over_rounds(spark):
    """The planner's size of a join is a product; carried over checkpoints its digits double each round, until planning never ends."""
    t = first = voronoi.cut(table(spark, clouds(40, 2, 1)).select("q", "v"))
    for _ in range(4):
        t = voronoi.cut(t.join(t.select("q"), "q").join(t.select("q"), "q"))
    size = lambda df: str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(t) == size(first) and t.count() == 40
