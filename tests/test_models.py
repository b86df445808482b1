"""Ranks in one layout, seeding over all rows, mini-batches and mixtures against plain versions."""

import numpy as np
import pandas as pd
import pytest

from kinetra.functions.stats import rank_rows, ranked
from kinetra.operators import eda
from kinetra.operators.cluster import kmeans, minibatch_kmeans, seed_candidates
from kinetra.operators.mixture import gaussian_mixture, gaussian_mixtures


def frame(spark, x):
    names = [f"c{j}" for j in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(x, columns=names)), names


def blobs(sizes, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(8 * k, 1 + k / 4, (n, 2)) for k, n in enumerate(sizes)])


def test_ranks_with_a_frequent_value(spark):
    rng = np.random.default_rng(0)
    x = pd.DataFrame({"a": np.where(rng.random(3_000) < 0.4, 0.0, rng.normal(size=3_000)), "b": rng.integers(0, 2_500, 3_000).astype(float), "_f": rng.normal(size=3_000).round(2)})
    x.loc[::50, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else v for v in map(float, row)) for row in x.to_numpy()], "a double, b double, _f double").repartition(5)
    got = ranked(df, ["a", "b", "_f"]).toPandas()
    assert len(got) == 3_000 and got.b_rank.isna().sum() == 60
    for c in x:
        pd.testing.assert_series_equal(got[c + "_rank"], got[c].rank(), check_names=False)
    rho = {(r.feature_a, r.feature_b): r.rho for r in eda.spearman(df, ["a", "_f"]).collect()}
    assert rho["a", "_f"] == pytest.approx(x.a.rank().corr(x._f.rank()), abs=1e-12)


def test_exchanges_of_ranks_do_not_grow_with_columns(spark):
    df, names = frame(spark, np.random.default_rng(0).normal(size=(50, 6)))
    plans = [rank_rows(df, some)[1]._jdf.queryExecution().executedPlan().toString() for some in (names[:2], names)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") > 0


def test_ranks_of_an_empty_table(spark):
    assert ranked(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect() == []


def test_seeds_come_from_all_rows(spark):
    x = np.concatenate([np.zeros((10_000, 2)), np.random.default_rng(2).normal(size=(20_000, 2)), [[900.0, 900.0], [900.5, 900.0]]])
    df, names = frame(spark, x)
    rows, weight = seed_candidates(df, names, 42, 16)
    again, weight2 = seed_candidates(df.repartition(7), names, 42, 16)
    assert weight.sum() == len(x) and len(rows) <= 96 and (rows.max(axis=1) > 800).any() and (np.abs(rows).sum(axis=1) == 0).any()
    assert np.array_equal(rows, again) and np.array_equal(weight, weight2)
    model = kmeans(df, names, 2, restarts=2)
    assert sorted(round(c[0], 1) for c in model.centres) == [0.0, 900.2]


def test_seeds_of_few_values(spark):
    df, names = frame(spark, np.repeat([[1.0, 2.0], [3.0, 4.0]], 5, axis=0))
    assert len(seed_candidates(df, names, 1, 8)[0]) == 2
    assert kmeans(df, names, 3, restarts=2).inertia == 0
    with pytest.raises(ValueError, match="no rows"):
        seed_candidates(df.limit(0), names, 1, 8)


def test_mini_batches_reach_the_clusters(spark):
    df, names = frame(spark, blobs((300, 200, 100)))
    assert minibatch_kmeans(df, names, 3, batches=4, starts=4).inertia == pytest.approx(kmeans(df, names, 3).inertia, rel=0.05)


def plain_mixture(x, centres, reg=1e-6, tol=1e-3, steps=300):
    share = np.eye(len(centres))[((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)]
    last, done = -np.inf, False
    for step in range(steps + 2):
        if step:
            dens = np.stack([w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(w_, m_, c_, strict=True)], axis=1)
            likely, share = np.log(dens.sum(axis=1)).mean(), dens / dens.sum(axis=1, keepdims=True)
            if done:
                return likely * len(x), share.argmax(axis=1)
            done = abs(likely - last) < tol
            last = likely
        n = share.sum(axis=0)
        w_, m_ = n / len(x), share.T @ x / n[:, None]
        c_ = [((x - m) * share[:, k : k + 1]).T @ (x - m) / n[k] + reg * np.eye(x.shape[1]) for k, m in enumerate(m_)]


def test_mixture_equals_the_plain_steps(spark):
    x = blobs((300, 200, 100), 3)
    df, names = frame(spark, x)
    likely, labels = plain_mixture(x, np.array(kmeans(df, names, 3, 1).centres))
    m = gaussian_mixture(df, names, 3)
    assert m.converged and m.log_likelihood == pytest.approx(likely) and m.bic == pytest.approx(17 * np.log(600) - 2 * likely) and m.aic == pytest.approx(34 - 2 * likely)
    got = m.predict(df).toPandas()
    by = {tuple(r): k for r, k in zip(x, labels, strict=True)}
    assert all(by[r.c0, r.c1] == r.label for r in got.itertuples())


def test_mixture_without_spread_and_without_time(spark):
    x = np.column_stack([np.repeat([0.0, 5.0], 20), np.ones(40)])
    df, names = frame(spark, x)
    found = gaussian_mixtures(df, names, (1, 2), restarts=2)
    assert found[2].converged and np.allclose(np.array(found[2].covariances), 1e-6 * np.eye(2)) and sorted(c[0] for c in found[2].means) == pytest.approx([0, 5])
    assert not gaussian_mixture(frame(spark, blobs((90, 60)))[0], names, 2, max_iter=1).converged
    with pytest.raises(ValueError, match="no rows"):
        gaussian_mixture(df.limit(0), names, 2)
