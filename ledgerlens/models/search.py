"""Splits, pipelines, sweeps over models and parameters, voting and scoring."""

from __future__ import annotations

import functools
import importlib
import json
import threading
from collections.abc import Mapping, Sequence
from dataclasses import astuple

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    FMClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Binarizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import FOLD_FACTOR, PICK_FACTOR, key_spot
from ledgerlens.models import newton
from ledgerlens.models.newton import NewtonBoostClassifier
from ledgerlens.models.boost import AdaBoostClassifier, AdaBoostModel, Plan, Stump, boosted
from ledgerlens.models.cells import candidate_splits, cell_table
from ledgerlens.models.forests import TreesClassifier, TreesModel
from ledgerlens.models.moments import DiscriminantClassifier, QuadraticModel, RidgeClassifier, linear_fold_errors
from ledgerlens.models.trees import LeanBoostedRegressor, LeanForestRegressor, LeanTreeRegressor
from ledgerlens.models.evaluate import regression_errors, summaries
from ledgerlens.operators.neighbors import _nearest_to_vectors
from ledgerlens.session import at_once, gathered, holding, materialized, remembered, reused, swept

# --- data ----------------------------------------------------------------------------------------------------------


def train_test_split(df: DataFrame, key: str, test_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by arithmetic on the key: a lost and recomputed partition splits the same way."""
    here = key_spot(F.col(key), seed) < test_share
    return df.filter(~here), df.filter(here)


def fold_number(key: str, folds: int, seed: int) -> Column:
    return F.floor(key_spot(F.col(key), seed, FOLD_FACTOR) * folds).cast("int")


def feature_stages(numbers: Sequence[str], texts: Sequence[str] = (), scale: bool = True) -> list:
    """Alphabetical codes for text columns, one vector, and standardisation."""
    stages: list = []
    if texts:
        stages.append(
            StringIndexer(inputCols=list(texts), outputCols=[f"{c}_code" for c in texts], stringOrderType="alphabetAsc", handleInvalid="keep")
        )
    inputs = [*numbers, *[f"{c}_code" for c in texts]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_features" if scale else "features"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return stages


# --- estimators ----------------------------------------------------------------------------------------------------


def bernoulli_bayes(smoothing: float = 1.0) -> Pipeline:
    """Naive Bayes on features cut at 0."""
    return Pipeline(
        stages=[Binarizer(threshold=0.0, inputCol="features", outputCol="binary"), NaiveBayes(modelType="bernoulli", smoothing=smoothing, featuresCol="binary")]
    )


def classifiers(n_features: int, seed: int = 42, rounds: int = 50, key: str | None = None) -> dict[str, Estimator]:
    """The models compared in a sweep; with a ``key`` column also the vote of nearest neighbours, bagged and random trees."""
    found: dict[str, Estimator] = {
        "LogisticRegression": LogisticRegression(maxIter=50),
        "DecisionTree": DecisionTreeClassifier(seed=seed),
        "RandomForest": RandomForestClassifier(seed=seed),
        "GradientBoosting": NewtonBoostClassifier(rounds=rounds, depth=3),
        "AdaBoost": AdaBoostClassifier(rounds=rounds, seed=seed),
        "BernoulliBayes": bernoulli_bayes(),
        "LinearSVC": LinearSVC(maxIter=50),
        "FactorizationMachine": FMClassifier(seed=seed, maxIter=50, stepSize=0.05),
        "Perceptron": MultilayerPerceptronClassifier(layers=[n_features, 8, 2], seed=seed, maxIter=50),
        "Ridge": RidgeClassifier(),
        "RidgeChosen": RidgeClassifier(penalties=[0.1, 1.0, 10.0]),
        "LinearDiscriminant": DiscriminantClassifier(),
        "QuadraticDiscriminant": DiscriminantClassifier(quadratic=True),
    }
    if key:
        found["KNeighbors"] = NearestVoteClassifier(key=key)
        found["BaggedTrees"] = TreesClassifier(key=key, trees=10, seed=seed)
        found["ExtraTrees"] = TreesClassifier(key=key, trees=100, random_splits=True, seed=seed)
    return found


def regressors(seed: int = 42, key: str | None = None) -> dict[str, Estimator]:
    """Linear, tree, forest and boosted regressors; with a ``key`` column also the nearest-neighbour mean."""
    found: dict[str, Estimator] = {
        "LinearRegression": LinearRegression(),
        "DecisionTree": LeanTreeRegressor(seed=seed),
        "RandomForest": LeanForestRegressor(seed=seed),
        "GradientBoosting": LeanBoostedRegressor(seed=seed, maxIter=20),
    }
    if key:
        found["KNeighbors"] = NearestMeanRegressor(key=key)
    return found


class NearestMeanRegressor(Estimator):
    """Mean label of the nearest training rows, as an estimator over the ``features`` vector."""

    def __init__(self, key: str, k: int = 5, label: str = "label"):
        super().__init__()
        self.key, self.k, self.label = key, k, label

    def _fit(self, dataset: DataFrame) -> NearestMeanModel:
        rows = dataset.select(F.lit(0).alias("g"), F.col(self.key).alias("_point"), vector_to_array("features").alias("v"), F.col(self.label).alias("_label"))
        return NearestMeanModel(rows, self.key, self.k)  # read again where they are used, as a copy may be larger than the input


class NearestMeanModel(Model):
    def __init__(self, rows: DataFrame, key: str, k: int):
        super().__init__()
        self.rows, self.key, self.k = rows, key, k

    def _parts(self) -> tuple[DataFrame, str, int]:
        return self.rows, self.key, self.k

    def _transform(self, dataset: DataFrame) -> DataFrame:
        asked = dataset.select(F.lit(0).alias("g"), F.col(self.key).alias("_query"), vector_to_array("features").alias("v"))
        with holding() as hold:
            found = _nearest_to_vectors(asked, self.rows.select("g", "_point", "v"), self.k, hold=hold)
            found = materialized(found.withColumn("_vector", F.monotonically_increasing_id()), "neighbours")  # written, so the numbers stay
        swept(dataset.sparkSession)  # the search's shuffle files, before those of the joins below
        pairs = found.select("_vector", F.explode("neighbours").alias("e")).select("_vector", F.col("e.id").alias("_point"))
        labels = self.rows.select("_point", F.col("_label").cast("double").alias("_label"))
        # labels meet distinct vectors, which may be far fewer than rows
        totals = pairs.join(labels, "_point").groupBy("_vector").agg(F.sum("_label").alias("_sum"), F.count("_label").alias("_n"))
        told = found.select("g", "v", "_vector").join(totals, "_vector").select("g", "v", "_sum", "_n")
        means = asked.join(told, ["g", "v"]).groupBy(F.col("_query").alias(self.key)).agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("prediction"))
        return dataset.join(means, self.key, "left")


class NearestVoteClassifier(NearestMeanRegressor):
    """The class most of the nearest training rows have; labels are 0 and 1."""

    def _fit(self, dataset: DataFrame) -> NearestVoteModel:
        return NearestVoteModel(*super()._fit(dataset)._parts())


class NearestVoteModel(NearestMeanModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = super()._transform(dataset)
        share = F.col("prediction")
        return told.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - share, share))).withColumn("prediction", (share > 0.5).cast("double"))


class CalibratedMargin(Estimator):
    """A margin classifier with probabilities: a logistic curve on margins of rows left out of the fit."""

    def __init__(self, estimator: Estimator, key: str, folds: int = 3, seed: int = 42):
        super().__init__()
        self.estimator, self.key, self.folds, self.seed = estimator, key, folds, seed

    def _fit(self, dataset: DataFrame) -> CalibratedModel:
        rows = reused(dataset.withColumn("_fold", fold_number(self.key, self.folds, self.seed)))
        held_out = None
        for fold in range(self.folds):
            model = self.estimator.fit(rows.filter(F.col("_fold") != fold))
            told = _margin(model.transform(rows.filter(F.col("_fold") == fold))).select("_margin", "label")
            held_out = told if held_out is None else held_out.unionByName(told)
        curve = LogisticRegression(featuresCol="_margin", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r").fit(held_out)
        model = self.estimator.fit(rows)
        rows.unpersist()
        return CalibratedModel(model, float(curve.coefficients[0]), float(curve.intercept))


class CalibratedModel(Model):
    def __init__(self, model: Model, slope: float, intercept: float):
        super().__init__()
        self.model, self.slope, self.intercept = model, slope, intercept

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = _margin(self.model.transform(dataset))
        margin = vector_to_array("_margin")[0]
        one = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * margin + F.lit(self.intercept))))
        return told.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - one, one))).drop("_margin")


def _margin(told: DataFrame) -> DataFrame:
    return told.withColumn("_margin", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))


class SoftVote(Model):
    """Mean of the class probabilities of fitted models."""

    def __init__(self, models: Sequence[Model]):
        super().__init__()
        self.models = list(models)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        voted = dataset
        for i, model in enumerate(self.models):
            told = model.transform(voted)
            voted = told.withColumn(f"_vote{i}", vector_to_array("probability")).select(*voted.columns, f"_vote{i}")
        names = [f"_vote{i}" for i in range(len(self.models))]
        means = [sum((F.col(n)[c] for n in names), F.lit(0.0)) / F.lit(float(len(names))) for c in range(2)]
        return (
            voted.withColumn("probability", array_to_vector(F.array(*means)))
            .withColumn("prediction", (vector_to_array("probability")[1] > 0.5).cast("double"))
            .drop(*names)
        )


# --- comparison and tuning -----------------------------------------------------------------------------------------


def held_out_predictions(train: DataFrame, test: DataFrame, candidates: Mapping[str, Estimator], key: str) -> DataFrame:
    """(model, key, label, prediction, score) of every model on every test row, written: one table for all evaluation.

    ``score`` orders rows by how likely class 1 is: the probability, else the margin, else the prediction.
    """

    def told(name: str, estimator: Estimator) -> DataFrame:
        found = estimator.fit(train).transform(test)
        column = next((c for c in ("probability", "rawPrediction") if c in found.columns), None)
        score = vector_to_array(column)[1] if column else F.col("prediction")
        return materialized(found.select(F.lit(name).alias("model"), F.col(key), F.col("label").cast("double").alias("label"), "prediction", score.alias("score")), "predictions")

    parts = at_once(train.sparkSession, [lambda n=n, e=e: told(n, e) for n, e in candidates.items()])
    return functools.reduce(DataFrame.unionAll, parts)


def model_sweep(train: DataFrame, test: DataFrame, candidates: Mapping[str, Estimator], key: str) -> DataFrame:
    """Fit every model and rank by weighted F1, then accuracy. For two classes the area of hard predictions equals the
    balanced accuracy, which is what the sweep reports."""
    found = summaries(held_out_predictions(train, test, candidates, key))
    return found.select("model", "accuracy", "balanced_accuracy", F.col("balanced_accuracy").alias("roc_auc"), "f1").orderBy(F.desc("f1"), F.desc("accuracy"), "model")


def grid_search(estimator: Estimator, grid: Sequence[dict], train: DataFrame, key: str, folds: int = 5, seed: int = 42, parallelism: int = 8) -> CrossValidatorModel:
    """Cross-validated choice by F1 of class 1 over folds taken from a hash of the key."""
    positive = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=list(grid), evaluator=positive, parallelism=parallelism, foldCol="_fold", numFolds=folds
    )
    rows = gathered(train.withColumn("_fold", fold_number(key, folds, seed)))
    found = search.fit(rows)
    rows.unpersist()
    return found


def boosting_grid(rounds: Sequence[int], rates: Sequence[float], algorithms: Sequence[str], train: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Mean F1 of class 1 over folds of all combinations for adaptive boosting, as ``(parameters, f1)``, best first.

    Every rate, algorithm and fold is one plan of a single boosting run with the most rounds; fewer rounds are scored on
    its way. Thresholds are taken from all training rows, as they hold no labels.
    """
    rows = reused(train.select(F.col(key), vector_to_array("features").alias("x"), "label"))
    splits = candidate_splits(rows, "x")
    choices = [(rate, algorithm) for rate in rates for algorithm in algorithms]
    plans = [Plan(rate, algorithm == "SAMME", fold) for rate, algorithm in choices for fold in range(folds)]
    cells = cell_table(rows, "x", "label", fold_number(key, folds, seed), splits, len(plans))
    _, _, scores = boosted(cells, splits, plans, max(rounds), sorted(rounds))
    rows.unpersist()
    found = [(f"algorithm={algorithm}, rate={rate}, rounds={n}", v) for n in rounds for (rate, algorithm), v in zip(choices, _mean_f1(scores[n], folds), strict=True)]
    return train.sparkSession.createDataFrame(found, "parameters string, f1 double").orderBy(F.desc("f1"), "parameters")


def newton_grid(rounds: Sequence[int], rates: Sequence[float], depths: Sequence[int], train: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Mean F1 of class 1 over folds of all combinations for second-order boosted trees, as ``(parameters, f1)``, best first.

    Every rate, depth and fold is one plan of a single run with the most rounds; fewer rounds are scored on its way.
    """
    rows = reused(train.select(F.col(key), vector_to_array("features").alias("x"), "label"))
    splits = candidate_splits(rows, "x")
    choices = [(rate, depth) for rate in rates for depth in depths]
    plans = [newton.Plan(rate, depth, fold) for rate, depth in choices for fold in range(folds)]
    cells = cell_table(rows, "x", "label", fold_number(key, folds, seed), splits, len(plans))
    _, scores = newton.newton_boosted(cells, splits, plans, max(rounds), sorted(rounds))
    rows.unpersist()
    found = [(f"depth={depth}, rate={rate}, rounds={n}", v) for n in rounds for (rate, depth), v in zip(choices, _mean_f1(scores[n], folds), strict=True)]
    return train.sparkSession.createDataFrame(found, "parameters string, f1 double").orderBy(F.desc("f1"), "parameters")


def _mean_f1(counts: np.ndarray, folds: int) -> list[float]:
    """F1 of every choice, averaged over its folds; ``counts`` has hits, false alarms and misses of each (choice, fold)."""
    hit, false, missed = counts[:3]
    return (2 * hit / np.maximum(2 * hit + false + missed, 1)).reshape(-1, folds).mean(1).tolist()


def boosting_curves(train: DataFrame, key: str, fractions: Sequence[float], folds: int = 5, seed: int = 42, rounds: int = 50) -> list[tuple[str, float, float, float]]:
    """Learning curves of both boosted models: ``(model, fraction, train accuracy, validation accuracy)``.

    A fraction is all bands of keys up to it, so every fraction and fold is one plan over the same cells.
    """
    rows = reused(train.select(F.col(key), vector_to_array("features").alias("x"), "label"))
    splits = candidate_splits(rows, "x")
    spot = key_spot(F.col(key), seed, PICK_FACTOR)
    band = sum(((spot >= f).cast("int") for f in sorted(fractions)), F.lit(0))
    asked = [(f, k) for f in sorted(fractions) for k in range(folds)]
    where = {f: i for i, f in enumerate(sorted(fractions))}

    def cells():
        return cell_table(rows, "x", "label", fold_number(key, folds, seed), splits, len(asked), band)

    _, _, ada = boosted(cells(), splits, [Plan(1.0, False, k, where[f]) for f, k in asked], rounds, [rounds])
    _, second = newton.newton_boosted(cells(), splits, [newton.Plan(0.3, 3, k, band=where[f]) for f, k in asked], rounds, [rounds])
    rows.unpersist()
    found = []
    for name, scores in (("AdaBoost", ada[rounds]), ("GradientBoosting", second[rounds])):
        right, count, train_right, train_count = scores[3:]
        shares = [v.reshape(-1, folds).mean(1) for v in (train_right / np.maximum(train_count, 1), right / np.maximum(count, 1))]
        found += [(name, float(f), float(a), float(b)) for f, a, b in zip(sorted(fractions), *shares, strict=True)]
    return found


def parameter_grid(choices: Mapping) -> list[dict]:
    """All combinations of ``{param: values}``."""
    builder = ParamGridBuilder()
    for param, values in choices.items():
        builder = builder.addGrid(param, list(values))
    return builder.build()


def grid_results(model: CrossValidatorModel, spark) -> DataFrame:
    """``(parameters, f1)`` of every combination tried, best first."""
    rows = [
        (", ".join(sorted(f"{p.name}={v}" for p, v in params.items())), float(score))
        for params, score in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return spark.createDataFrame(rows, "parameters string, f1 double").orderBy(F.desc("f1"), "parameters")


def cross_validated_rmse(train: DataFrame, key: str, candidates: Mapping[str, Estimator], stages: Sequence, folds: int = 10, seed: int = 42) -> DataFrame:
    """Root mean squared error of every model on every fold: ``(model, fold, rmse)``.

    ``stages`` prepare the features once per training part. A plain linear regression needs no fit for each fold: its errors
    on all of them follow from one pass (scaling the features changes no prediction). The other fits run a few at a time, fold
    after fold, the longest first.
    """
    rows = remembered(train.withColumn("_fold", fold_number(key, folds, seed)))
    spark = train.sparkSession
    plain = [n for n, e in candidates.items() if type(e) is LinearRegression and e.getRegParam() == 0 and e.getFitIntercept()]
    fitted = [n for n in candidates if n not in plain]
    scores = []
    if plain:
        prepared = Pipeline(stages=list(stages)).fit(rows).transform(rows)
        errors = linear_fold_errors(prepared, F.col("_fold"), vector_to_array("features"), F.col("label"))
        scores += [(n, f, e) for n in plain for f, e in errors.items()]

    def of_fold(fold: int) -> list[DataFrame]:
        inside = rows.filter(F.col("_fold") != fold).drop("_fold")
        prepared = Pipeline(stages=list(stages)).fit(inside)
        parts = inside, rows.filter(F.col("_fold") == fold).drop("_fold")
        return [remembered(prepared.transform(p).select(key, "features", "label")) for p in parts]

    # a fold's rows are kept from its first fit to its last
    parts: list[list[DataFrame]] = [[] for _ in range(folds)]
    left, locks = [len(fitted)] * folds, [threading.Lock() for _ in range(folds)]

    def of_model(name: str, fold: int) -> tuple[str, int, float]:
        with locks[fold]:
            parts[fold] = parts[fold] or of_fold(fold)
        told = candidates[name].fit(parts[fold][0]).transform(parts[fold][1])
        found = name, fold, regression_errors(told).first()["rmse"]
        with locks[fold]:
            left[fold] -= 1
            if not left[fold]:
                for part in parts[fold]:
                    part.unpersist()
                parts[fold] = []
        return found

    scores += at_once(spark, [lambda n=n, f=f: of_model(n, f) for f in range(folds) for n in reversed(fitted)], parallelism=8)
    rows.unpersist()
    return spark.createDataFrame(scores, "model string, fold int, rmse double")


def compare_feature_sets(train: DataFrame, test: DataFrame, feature_sets: Mapping[str, tuple[Sequence[str], Sequence[str]]], candidates: Mapping[str, Estimator]) -> DataFrame:
    """Errors of the same models on different columns: ``(columns, model, r2, mae, mse, rmse)``.

    One set follows the other, and rows are read again for every pass: copies of them with their vectors are several times
    the input, and two sets' at once filled the disk.
    """
    spark = train.sparkSession
    needed = {"label", *(e.key for e in candidates.values() if isinstance(e, NearestMeanRegressor))}
    used = {c for numbers, texts in feature_sets.values() for c in (*numbers, *texts)} - needed
    rows = []

    def errors(label: str, name: str, parts: Sequence[DataFrame]) -> tuple:
        m = regression_errors(candidates[name].fit(parts[0]).transform(parts[1])).first()
        return label, name, m["r2"], m["mae"], m["mse"], m["rmse"]

    for label, (numbers, texts) in feature_sets.items():
        prepared = Pipeline(stages=feature_stages(numbers, texts)).fit(train)
        spent = [*used, "raw_features", *[f"{c}_code" for c in texts]]
        parts = [prepared.transform(part).drop(*spent) for part in (train, test)]
        rows += at_once(spark, [lambda n=n: errors(label, n, parts) for n in candidates])
        swept(spark)
    return spark.createDataFrame(rows, "columns string, model string, r2 double, mae double, mse double, rmse double")


# --- persistence and scoring ---------------------------------------------------------------------------------------


def save_model(model: Model, path: str) -> None:
    """Write any fitted model of Spark ML or of this package, with the models and rows inside it, under ``path``."""
    meta: dict = {"module": type(model).__module__, "name": type(model).__name__}
    if isinstance(model, SoftVote):
        meta["models"] = len(model.models)
        parts = model.models
    elif isinstance(model, CalibratedModel):
        meta |= {"slope": model.slope, "intercept": model.intercept}
        parts = [model.model]
    elif isinstance(model, AdaBoostModel):
        meta |= {"votes": model.votes, "by_label": model.by_label, "stumps": [astuple(s) for s in model.stumps]}
        parts = []
    elif isinstance(model, newton.NewtonBoostModel):
        meta |= {"trees": [astuple(t) for t in model.trees]}
        parts = []
    elif isinstance(model, QuadraticModel):
        meta |= {"constant": model.constant, "linear": model.linear, "square": model.square, "odds": model.odds}
        parts = []
    elif isinstance(model, NearestMeanModel):
        meta |= {"key": model.key, "k": model.k}
        parts = []
        model.rows.write.mode("overwrite").parquet(f"{path}/rows")
    else:
        parts = []
        model.write().overwrite().save(f"{path}/model")
    for i, part in enumerate(parts):
        save_model(part, f"{path}/part{i}")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(path: str) -> Model:
    """What ``save_model`` wrote."""
    spark = SparkSession.active()
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    parts = lambda n: [load_model(f"{path}/part{i}") for i in range(n)]
    match meta["name"]:
        case "SoftVote":
            return SoftVote(parts(meta["models"]))
        case "CalibratedModel":
            return CalibratedModel(parts(1)[0], meta["slope"], meta["intercept"])
        case "AdaBoostModel":
            return AdaBoostModel([Stump(*s) for s in meta["stumps"]], meta["votes"], meta["by_label"])
        case "NewtonBoostModel" | "TreesModel" as name:
            return {"NewtonBoostModel": newton.NewtonBoostModel, "TreesModel": TreesModel}[name]([newton.Tree(*t) for t in meta["trees"]])
        case "QuadraticModel":
            return QuadraticModel(meta["constant"], meta["linear"], meta["square"], meta["odds"])
        case "NearestMeanModel" | "NearestVoteModel" as name:
            return {"NearestMeanModel": NearestMeanModel, "NearestVoteModel": NearestVoteModel}[name](spark.read.parquet(f"{path}/rows"), meta["key"], meta["k"])
    return getattr(importlib.import_module(meta["module"]), meta["name"]).load(f"{path}/model")


def scored(model: Model, df: DataFrame, name: str = "estimate") -> DataFrame:
    """Predictions of a stored model for a table, cut to whole numbers."""
    return model.transform(df).withColumn(name, F.col("prediction").cast("long"))
