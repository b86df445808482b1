"""Regressions of all folds in the same passes, against one fit of MLlib for each fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kinetra.operators.predictability import city_balanced_accuracy, dealt, fit_folds


@pytest.fixture(scope="module")
def towns(spark):
    rng = np.random.default_rng(5)
    y = rng.choice(3, 400, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(400, 2)) + np.array([[0, 0], [1.5, 0], [0, 2]])[y]
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "a": x[:, 0], "b": 10 * x[:, 1], "town": np.array(["p", "q", "r"])[y]}))


def test_same_models_and_scores_as_a_fit_for_each_fold(spark, towns):
    data, names = dealt(towns, ["a", "b"], "town", "id", 2, 42)
    data = data.persist()
    assert names == ["p", "q", "r"]
    models = fit_folds(data, 2, 3, 2, 2 / 400)
    vectors = VectorAssembler(inputCols=["_x0", "_x1"], outputCol="x").transform(data)
    means = []
    for k in range(2):
        fit = LogisticRegression(featuresCol="x", labelCol="_y", weightCol="_w", standardization=False, regParam=2 / 400, maxIter=200, tol=1e-10, family="multinomial").fit(vectors.where(F.col("_fold") != k))
        assert np.allclose(models[k][:2].T, fit.coefficientMatrix.toArray(), atol=1e-4)
        assert np.allclose(models[k][2] - models[k][2].mean(), fit.interceptVector.toArray() - fit.interceptVector.toArray().mean(), atol=1e-4)
        found = fit.transform(vectors.where(F.col("_fold") == k)).groupBy("_y").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("r"))
        means.append(found.agg(F.avg("r")).first()[0])
    got = city_balanced_accuracy(towns, ["a", "b"], "town", "id", 2).first()
    assert (got.balanced_accuracy_mean, got.balanced_accuracy_std, got.chance) == pytest.approx((np.mean(means), np.std(means, ddof=1), 1 / 3))


def test_separable_towns_one_town_and_none(spark):
    df = spark.createDataFrame([(i, float(i % 2 * 50), "pq"[i % 2] if i < 38 else None) for i in range(40)], "id long, a double, town string")
    got = city_balanced_accuracy(df, ["a"], "town", "id").first()
    assert (got.balanced_accuracy_mean, got.chance) == (1.0, 0.5)
    got = city_balanced_accuracy(df.where("town = 'p'"), ["a"], "town", "id").first()
    assert (got.balanced_accuracy_mean, got.chance) == (1.0, 1.0)
    with pytest.raises(ValueError, match="no rows"):
        city_balanced_accuracy(df.where("town IS NULL"), ["a"], "town", "id")
