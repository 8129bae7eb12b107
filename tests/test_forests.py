"""Bagged and extremely random trees: the same after repartitioning, splits as drawn, and better than one guess."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens.models import evaluate, search
from ledgerlens.models.forests import POISSON, TreesClassifier, _drawn, mixed


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()


@pytest.mark.parametrize("random_splits", [False, True])
def test_trees_learn_and_repeat(frame, random_splits, tmp_path):
    train, test = search.train_test_split(frame, "id", 0.3, 3)
    estimator = TreesClassifier(key="id", trees=12, depth=6, random_splits=random_splits)
    model = estimator.fit(train)
    assert evaluate.summary(model.transform(test))["accuracy"] > 0.85
    again = estimator.fit(train.repartition(5, F.rand(7)))
    assert again.trees == model.trees
    assert len({str(t.thresholds) for t in model.trees}) == 12
    search.save_model(model, str(tmp_path / "trees"))
    told = search.load_model(str(tmp_path / "trees")).transform(test).orderBy("id").select("probability").collect()
    assert told == model.transform(test).orderBy("id").select("probability").collect()


def test_one_full_tree_by_hand(spark):
    rows = [(i, [float(i % 4)], float(i % 4 in (1, 2))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    from pyspark.ml.functions import array_to_vector

    df = df.select("id", array_to_vector("x").alias("features"), "label")
    model = TreesClassifier(key="id", trees=1, depth=3, random_splits=True).fit(df)
    assert evaluate.summary(model.transform(df))["accuracy"] == 1.0


def test_draws():
    u = mixed(np.arange(100_000)[:, None], np.arange(2)[None, :], 42)
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u.T)[0, 1]) < 0.02
    n = np.searchsorted(POISSON, u, "right")
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03
    weight = np.zeros((2, 7, 3))
    weight[0, [0, 2, 3], :] = 1  # feature 0 has bins 0..3, feature 1 bins 4..6
    weight[0, [5], :] = 1
    allowed = _drawn(weight, [4, 3], 1, 42)
    assert allowed[0].sum(0).tolist() == [1, 1, 1] and not allowed[0, 3:].any() and not allowed[1].any()
