"""Regression trees without held rows against Spark's own, and what a comparison of models leaves behind."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ledgerlens.catalog import modelling
from ledgerlens.models import search, trees
from ledgerlens.session import holding


def _rows(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.integers(0, 2, n)
    y = np.round(3 * a - b + 5 * c * (a > 0) + rng.normal(size=n) / 2, 2)
    frame = pd.DataFrame({"id": np.arange(n), "a": np.round(a, 1), "b": b, "c": [["x", "y"][v] for v in c], "label": y})
    return spark.createDataFrame(frame).repartition(3, "id")


def _features(df, scale=True):
    from pyspark.ml import Pipeline

    return Pipeline(stages=search.feature_stages(["a", "b"], ["c"], scale)).fit(df).transform(df).select("id", "features", "label")


def _predictions(model, rows):
    return [r["prediction"] for r in model.transform(rows).orderBy("id").collect()]


@pytest.mark.parametrize("n", [1, 7, 900])
def test_lean_models_equal_sparks(spark, n):
    rows = _features(_rows(spark, n))
    pairs = [
        (trees.LeanTreeRegressor(seed=42), DecisionTreeRegressor(seed=42)),
        (trees.LeanTreeRegressor(seed=42, maxDepth=3, minInstancesPerNode=20, minInfoGain=0.1), DecisionTreeRegressor(seed=42, maxDepth=3, minInstancesPerNode=20, minInfoGain=0.1)),
        (trees.LeanBoostedRegressor(seed=42, maxIter=6, stepSize=0.3), GBTRegressor(seed=42, maxIter=6, stepSize=0.3)),
        (trees.LeanForestRegressor(seed=42, numTrees=5), RandomForestRegressor(seed=42, numTrees=5)),
        (trees.LeanForestRegressor(seed=7, numTrees=1, bootstrap=False), RandomForestRegressor(seed=7, numTrees=1, bootstrap=False)),
    ]
    for lean, own in pairs:
        assert _predictions(lean.fit(rows), rows) == pytest.approx(_predictions(own.fit(rows), rows), rel=1e-9), type(lean)


def test_lean_models_of_many_rows_and_flushed_cells(spark, monkeypatch):
    """More than 10,000 rows: Spark finds thresholds on a sample, the same one."""
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 50)
    rows = _features(_rows(spark, 12_000))
    for lean, own in ((trees.LeanTreeRegressor(seed=1), DecisionTreeRegressor(seed=1)), (trees.LeanBoostedRegressor(seed=1, maxIter=3), GBTRegressor(seed=1, maxIter=3))):
        assert _predictions(lean.fit(rows), rows) == pytest.approx(_predictions(own.fit(rows), rows), rel=1e-9)


def test_codes_and_many_cells_are_left_to_spark(spark, monkeypatch):
    coded = _features(_rows(spark, 200), scale=False)  # text codes are categories
    assert _predictions(trees.LeanForestRegressor(seed=3, numTrees=3).fit(coded), coded) == pytest.approx(_predictions(RandomForestRegressor(seed=3, numTrees=3).fit(coded), coded))
    assert _predictions(trees.LeanTreeRegressor(seed=3).fit(coded), coded) == pytest.approx(_predictions(DecisionTreeRegressor(seed=3).fit(coded), coded))
    monkeypatch.setattr(trees, "HELD_CELLS", 10)
    rows = _features(_rows(spark, 200))
    assert _predictions(trees.LeanTreeRegressor(seed=3).fit(rows), rows) == pytest.approx(_predictions(DecisionTreeRegressor(seed=3).fit(rows), rows))


@pytest.mark.parametrize("bad", ["CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)"])
def test_labels_are_checked(spark, bad):
    rows = _features(_rows(spark, 20)).withColumn("label", F.expr(f"IF(id = 3, {bad}, label)"))
    for model in (trees.LeanTreeRegressor(), trees.LeanBoostedRegressor(maxIter=2), trees.LeanForestRegressor(numTrees=2)):
        with pytest.raises(Exception, match="(?i)label"):
            model.fit(rows)


def test_models_are_saved(spark, tmp_path):
    rows = _features(_rows(spark, 100))
    for i, model in enumerate((trees.LeanTreeRegressor(), trees.LeanBoostedRegressor(maxIter=3), trees.LeanForestRegressor(numTrees=2))):
        fitted = model.fit(rows)
        search.save_model(fitted, str(tmp_path / str(i)))
        assert _predictions(search.load_model(str(tmp_path / str(i))), rows) == _predictions(fitted, rows)


def _persisted(spark):
    return set(spark.sparkContext._jsc.getPersistentRDDs().keys())


def test_comparison_holds_no_rows(spark):
    """rows of both sets and the neighbours' frames stayed persisted, and the training rows were written once more."""
    df, before = _rows(spark, 60), _persisted(spark)
    found = search.compare_feature_sets(df, df, {"all": (["a", "b"], ["c"]), "one": (["a"], [])}, search.regressors(key="id"))
    assert found.count() == 10 and _persisted(spark) == before


def test_rows_are_read_set_by_set(spark, monkeypatch):
    """the models of both sets were fitted at the same time."""
    waves = []
    monkeypatch.setattr(search, "at_once", lambda spark, tasks: waves.append(len(tasks)) or [t() for t in tasks])
    df = _rows(spark, 30)
    search.compare_feature_sets(df, df, {"all": (["a", "b"], ["c"]), "one": (["a"], [])}, {"DecisionTree": trees.LeanTreeRegressor()})
    assert waves == [1, 1]


def test_holding_releases(spark):
    before = _persisted(spark)
    with holding() as hold:
        held = hold(spark.range(5))
        assert held.count() == 5 and _persisted(spark) != before
    assert _persisted(spark) == before


def test_boosting_needs_no_job_a_round(spark):
    """a boosted model of 20 rounds cost over a hundred jobs, in each of ten folds."""
    rows = _features(_rows(spark, 50))
    spark.sparkContext.setJobGroup("boosted", "")
    search.regressors()["GradientBoosting"].fit(rows)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")) < 20


def test_folds_are_released(spark):
    """all folds' rows were held until the last model, and frames of the neighbours beyond."""
    df, before, held = _rows(spark, 60), _persisted(spark), []
    candidates = {"DecisionTree": trees.LeanTreeRegressor(), "KNeighbors": search.NearestMeanRegressor("id")}
    whole = search.at_once

    def one_by_one(spark, tasks, parallelism=6):
        out = []
        for task in tasks:
            out += whole(spark, [task])
            held.append(len(_persisted(spark) - before))
        return out

    search.at_once, kept = one_by_one, search.at_once
    try:
        found = search.cross_validated_rmse(df, "id", candidates, search.feature_stages(["a", "b"], ["c"]), folds=3)
    finally:
        search.at_once = kept
    assert found.count() == 6 and _persisted(spark) == before
    assert max(held) <= 3 and held[1::2] == [1] * 3  # the rows, and one fold's two parts until its last fit


def test_priced_lines_are_not_copied(spark, tmp_path):
    """both parts of the lines were persisted, and spilled beside the input."""
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    lines = spark.createDataFrame([(i, i, i, 1, 1.0, float(i), 0.1, 0.2, "A", "O") for i in range(50)], kind)
    lines.withColumn("l_shipdate", F.lit("2020-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = modelling._prices(spark, str(tmp_path))
    assert sum(p.count() for p in parts) == 50
    assert not any(p.storageLevel.useDisk or p.storageLevel.useMemory for p in parts)


def test_forest_holds_rows_in_memory_only(spark, monkeypatch):
    """Spark's forest persists drawn rows on disk where memory ends."""
    asked, own = [], type(spark.sparkContext)._getJavaStorageLevel
    monkeypatch.setattr(type(spark.sparkContext), "_getJavaStorageLevel", lambda self, level: asked.append(level) or own(self, level))
    rows, before = _features(_rows(spark, 40)), _persisted(spark)
    search.regressors()["RandomForest"].fit(rows)
    assert asked and not any(level.useDisk for level in asked) and _persisted(spark) == before
