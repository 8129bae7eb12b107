"""Metrics against published reports, and invariants of fitted models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens.models import boost, cells, clusters, evaluate, newton, search

# confusion matrix (true 0: hit, miss; true 1: miss, hit) and the printed report rows
REPORTS = [
    ((86, 8, 27, 24), {"0": (0.76, 0.91, 0.83, 94), "1": (0.75, 0.47, 0.58, 51), "macro avg": (0.76, 0.69, 0.70, 145), "weighted avg": (0.76, 0.76, 0.74, 145)}, 0.758),
    ((69, 25, 16, 35), {"0": (0.81, 0.73, 0.77, 94), "1": (0.58, 0.69, 0.63, 51), "macro avg": (0.70, 0.71, 0.70, 145), "weighted avg": (0.73, 0.72, 0.72, 145)}, 0.717),
    ((82, 12, 28, 23), {"0": (0.75, 0.87, 0.80, 94), "1": (0.66, 0.45, 0.53, 51), "macro avg": (0.70, 0.66, 0.67, 145), "weighted avg": (0.71, 0.72, 0.71, 145)}, 0.724),
    ((77, 17, 20, 31), {"0": (0.79, 0.82, 0.81, 94), "1": (0.65, 0.61, 0.63, 51), "macro avg": (0.72, 0.71, 0.72, 145), "weighted avg": (0.74, 0.74, 0.74, 145)}, 0.744),
]


@pytest.mark.parametrize("cells, rows, accuracy", REPORTS)
def test_report_matches_published(spark, cells, rows, accuracy):
    counts = spark.createDataFrame(
        [(0.0, 0.0, cells[0]), (0.0, 1.0, cells[1]), (1.0, 0.0, cells[2]), (1.0, 1.0, cells[3])], "label double, prediction double, count long"
    )
    report = {r["name"]: r for r in evaluate.classification_report(counts).collect()}
    for name, figures in rows.items():
        got = report[name]
        assert (got["precision"], got["recall"], got["f1"]) == pytest.approx(figures[:3], abs=0.00501)
        assert got["support"] == figures[3]
    assert report["accuracy"]["f1"] == pytest.approx(accuracy, abs=0.001)


def test_roc_with_ties_across_ranges(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"score": rng.integers(0, 30, 400) / 30.0, "label": rng.integers(0, 2, 400)})
    df = spark.createDataFrame(frame)
    pos, neg = frame[frame["label"] == 1]["score"].to_numpy(), frame[frame["label"] == 0]["score"].to_numpy()
    expected = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_area(df).first()["auc"] == pytest.approx(expected)
    assert evaluate.roc_area(df, rows_per_task=5).first()["auc"] == pytest.approx(expected)
    points = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_points(df).collect())
    assert np.trapezoid([p[1] for p in points], [p[0] for p in points]) == pytest.approx(expected)
    assert evaluate.roc_area(df.filter("label = 1")).first()["auc"] is None


def test_regression_errors(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")
    r = evaluate.regression_errors(df).first()
    assert (r["mae"], r["mse"], r["rmse"]) == pytest.approx((0.5, 1.25 / 3, (1.25 / 3) ** 0.5))
    assert r["r2"] == pytest.approx(1 - 1.25 / sum((v - 7 / 3) ** 2 for v in (1, 2, 4)))
    assert evaluate.regression_errors(df.limit(1)).first()["r2"] is None


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (rng.random(400) < 0.1)).astype(float)
    frame = pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y})
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(frame))
    return df.select("id", "features", "label").persist()


def test_split_is_repeatable_and_complete(labelled):
    train, test = search.train_test_split(labelled, "id", 0.25, 42)
    again, _ = search.train_test_split(labelled.repartition(3), "id", 0.25, 42)
    ids = {r["id"] for r in train.collect()}
    assert ids == {r["id"] for r in again.collect()}
    assert train.count() + test.count() == 400 and 60 < test.count() < 140


@pytest.mark.parametrize("algorithm", ["SAMME", "SAMME.R"])
def test_boosting_learns_the_split(labelled, algorithm):
    model = boost.AdaBoostClassifier(rounds=3, algorithm=algorithm).fit(labelled)
    told = model.transform(labelled)
    assert evaluate.summary(told)["accuracy"] > 0.85
    assert len(model.stumps) == len(model.votes) <= 3


def test_soft_vote_and_calibrated_margin(labelled):
    from pyspark.ml.functions import vector_to_array

    svc = search.CalibratedMargin(LinearSVC(maxIter=10), "id", folds=2).fit(labelled)
    bayes = search.bernoulli_bayes().fit(labelled)
    told = search.SoftVote([svc, bayes]).transform(labelled).withColumn("p", vector_to_array("probability")).persist()
    assert set(told.columns) == {"id", "features", "label", "probability", "prediction", "p"}
    assert told.filter(F.abs(F.col("p")[0] + F.col("p")[1] - 1) > 1e-9).count() == 0
    assert evaluate.summary(told)["accuracy"] > 0.8


def test_kmodes_finds_planted_groups(spark):
    rows = [(i, *("aaa" if i % 2 else "bbb")) for i in range(40)] + [(100, "a", "a", "b")]
    df = spark.createDataFrame(rows, "id int, x string, y string, z string")
    modes, cost = clusters.fit_kmodes(df, ["x", "y", "z"], 2)
    assert set(modes) == {("a", "a", "a"), ("b", "b", "b")} and cost == 1
    costs = clusters.kmodes_costs(df, ["x", "y", "z"], [1, 2])
    assert costs[0][1] >= costs[1][1]


def test_kmeans_cost_of_one_cluster_is_the_spread(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10, 11, 12)], "x double")
    costs = clusters.kmeans_costs(df, ["x"], [1, 2])
    assert costs[0][1] == pytest.approx(np.var([1, 2, 3, 10, 11, 12]) * 6) and costs[1][1] == pytest.approx(4.0)
    assert clusters.knee([(1, 100.0), (2, 20.0), (3, 10.0), (4, 5.0)]) == 2


def test_least_costs_of_one_column(spark):
    rng = np.random.default_rng(17)
    for values in (np.round(rng.normal(size=60), 1), rng.integers(0, 4, 30).astype(float), np.array([2.0]), np.repeat([1.0, 5.0], 3)):
        v = np.sort(values)
        cost = lambda i, j: ((v[i:j] - v[i:j].mean()) ** 2).sum()  # noqa: B023, E731
        best = [cost(0, j) if j else 0.0 for j in range(len(v) + 1)]
        expected = [best[-1]]
        for _ in range(7):
            best = [min([best[j], *[best[i] + cost(i, j) for i in range(1, j)]]) if j else 0.0 for j in range(len(v) + 1)]
            expected.append(best[-1])
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
        found = clusters.exact_costs(df, "x", 8)
        assert [k for k, _ in found] == list(range(1, min(8, len(set(values))) + 1))
        assert [c for _, c in found] == pytest.approx(expected[: len(found)], abs=1e-9)
    assert clusters.exact_costs(df.limit(0), "x", 2) == []


def test_nearest_mean_regressor(labelled):
    model = search.NearestMeanRegressor("id", k=3).fit(labelled)
    told = model.transform(labelled)
    assert told.count() == 400 and told.filter("prediction is null").count() == 0


def test_saved_model_scores_alike(spark, labelled, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    model = Pipeline(stages=[LinearRegression()]).fit(labelled)
    search.save_model(model, str(tmp_path / "model"))
    again = search.scored(search.load_model(str(tmp_path / "model")), labelled)
    assert [r["prediction"] for r in again.orderBy("id").collect()] == [r["prediction"] for r in model.transform(labelled).orderBy("id").collect()]


def test_own_models_are_saved(labelled, tmp_path):
    boosted = boost.AdaBoostClassifier(rounds=3).fit(labelled)
    margin = search.CalibratedMargin(LinearSVC(maxIter=5), "id", folds=2).fit(labelled)
    models = {"boost": boosted, "vote": search.SoftVote([boosted, margin]), "nearest": search.NearestMeanRegressor("id", k=3).fit(labelled)}
    for name, model in models.items():
        search.save_model(model, str(tmp_path / name))
        again = search.load_model(str(tmp_path / name)).transform(labelled)
        assert [r["prediction"] for r in again.orderBy("id").collect()] == [r["prediction"] for r in model.transform(labelled).orderBy("id").collect()]


def test_all_regressors_cross_validated(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(120), "a": x[:, 0], "b": x[:, 1], "label": 3 * x[:, 0] - x[:, 1]}))
    scores = search.cross_validated_rmse(df, "id", search.regressors(key="id"), search.feature_stages(["a", "b"]), folds=2).groupBy("model").agg(F.avg("rmse").alias("rmse"))
    found = {r["model"]: r["rmse"] for r in scores.collect()}
    assert set(found) == {"LinearRegression", "DecisionTree", "RandomForest", "GradientBoosting", "KNeighbors"}
    assert found["LinearRegression"] < 1e-6 and max(found.values()) < 3.2


def test_curves_of_boosting_equal_single_fits(labelled):
    found = {(n, f): scores for n, f, *scores in search.boosting_curves(labelled, "id", (0.5, 1.0), folds=2, rounds=3)}
    assert set(found) == {(n, f) for n in ("AdaBoost", "GradientBoosting") for f in (0.5, 1.0)}
    assert all(0.8 < v <= 1 for scores in found.values() for v in scores)
    measure = lambda d: evaluate.summary(d)["accuracy"]
    single = evaluate.learning_curves(labelled, "id", {"LogisticRegression": search.classifiers(3)["LogisticRegression"]}, measure, (0.5, 1.0), 2)
    assert [(n, f) for n, f, *_ in single] == [("LogisticRegression", 0.5), ("LogisticRegression", 1.0)]


def test_predictions_of_all_models(labelled):
    import duckdb

    train, test = search.train_test_split(labelled, "id", 0.4, 7)
    chosen = {n: e for n, e in search.classifiers(3, rounds=3, key="id").items() if n in ("Ridge", "LinearDiscriminant", "KNeighbors", "LogisticRegression")}
    told = search.held_out_predictions(train, test, chosen, "id").persist()
    assert told.count() == 4 * test.count()
    local = told.toPandas()
    report = evaluate.classification_report(evaluate.confusion(told, by=["model"]), ["model"])
    for r in report.where("name IN ('0', '1')").collect():
        c, mine = float(r["name"]), local[local["model"] == r["model"]]
        hits = ((mine["prediction"] == c) & (mine["label"] == c)).sum()
        assert r["precision"] == pytest.approx(hits / max((mine["prediction"] == c).sum(), 1)) and r["support"] == (mine["label"] == c).sum()
    areas = duckdb.sql("""SELECT model, sum((a.score > b.score)::INT + (a.score = b.score)::INT / 2) / count(*) AS auc
        FROM local a JOIN local b USING (model) WHERE a.label = 1 AND b.label = 0 GROUP BY model""").fetchall()
    for rows_per_task in (10**6, 7):
        found = evaluate.roc_ladders(told, rows_per_task=rows_per_task).groupBy("model").agg(F.max("auc").alias("auc"), F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr")).collect()
        assert {r["model"]: r["auc"] for r in found} == pytest.approx(dict(areas))
        assert all(r["fpr"] == r["tpr"] == 1 for r in found)
    swept = search.model_sweep(train, test, chosen, "id").collect()
    assert [r["f1"] for r in swept] == sorted((r["f1"] for r in swept), reverse=True) and len(swept) == 4


@pytest.mark.parametrize("algorithm", ["SAMME", "SAMME.R"])
def test_first_trees_are_the_fit_of_fewer_rounds(labelled, algorithm):
    model = boost.AdaBoostClassifier(rounds=7, algorithm=algorithm).fit(labelled)
    for n, told in model.staged(labelled, [2, 7]):
        fewer = boost.AdaBoostClassifier(rounds=n, algorithm=algorithm).fit(labelled).transform(labelled)
        assert {(r["id"], r["prediction"]) for r in told.collect()} == {(r["id"], r["prediction"]) for r in fewer.collect()}


def test_boosting_grid_has_every_combination(labelled):
    found = search.boosting_grid([1, 2], [0.5, 1.2], ["SAMME", "SAMME.R"], labelled, "id", folds=2)
    assert found.count() == 8 and {r["parameters"] for r in found.collect()} >= {"algorithm=SAMME, rate=0.5, rounds=1", "algorithm=SAMME.R, rate=1.2, rounds=2"}


def test_registered_grids_are_whole(monkeypatch):
    from ledgerlens.catalog import modelling

    asked = []
    monkeypatch.setattr(modelling, "_documents", lambda *_: (None, None))
    monkeypatch.setattr(search, "boosting_grid", lambda rounds, rates, algorithms, *_, folds=5: asked.append((len(rounds) * len(rates) * len(algorithms), max(rounds), folds)))
    modelling.boosting_grid_search(None, None)
    assert asked == [(50, 200, 5)]


def numpy_boost(x, y, splits, rounds, rate, by_label):
    """Weights by row, every threshold tried: margins after each round."""
    w, margin, out = np.ones(len(y)), np.zeros(len(y)), []
    for _ in range(rounds):
        best = None
        for f, thresholds in enumerate(splits):
            for t in thresholds:
                left = x[:, f] <= t
                cost = sum(2 * w[s & (y == 0)].sum() * w[s & (y == 1)].sum() / max(w[s].sum(), 1e-300) for s in (left, ~left))
                if best is None or cost < best[0] * (1 - 1e-9):
                    best = (cost, left)
        left = best[1]
        one = [w[s & (y == 1)].sum() / w[s].sum() for s in (left, ~left)]
        p = np.where(left, *one)
        told = (p > 0.5).astype(float)
        error = w[told != y].sum() / w.sum()
        if by_label and error >= 0.5:
            break
        if by_label:
            vote = rate * np.log((1 - error) / error)
            margin, w = margin + vote * (2 * told - 1), w * np.exp(vote * (told != y))
        else:
            lean = np.log(p) - np.log(1 - p)
            margin, w = margin + lean, w * np.exp(-rate / 2 * (2 * y - 1) * lean)
        w = w / w.sum()
        out.append(margin.copy())
    return out


@pytest.mark.parametrize("by_label", [True, False])
def test_boosting_equals_weights_by_row(spark, labelled, by_label):
    from pyspark.ml.functions import vector_to_array

    rows = labelled.select("id", vector_to_array("features").alias("x"), "label")
    splits = cells.candidate_splits(rows, "x", bins=6)
    fold = (F.col("id") % 3).cast("int")
    plans = [boost.Plan(rate, by_label, held) for rate in (0.5, 1.2) for held in (-1, 0, 2)]
    stumps, _, scores = boost.boosted(cells.cell_table(rows, "x", "label", fold, splits, len(plans)), splits, plans, 25, [3, 25])
    local = rows.orderBy("id").collect()
    x, y, ids = np.array([r["x"] for r in local]), np.array([r["label"] for r in local]), np.array([r["id"] for r in local])
    for p, plan in enumerate(plans):
        inside = ids % 3 != plan.held_out
        told = numpy_boost(x[inside], y[inside], splits, 25, plan.rate, by_label)
        margin = np.zeros(len(y))
        for turn, s in enumerate(stumps[p]):
            margin += np.where(x[:, s.feature] <= s.threshold, s.left, s.right)
            assert np.allclose(margin[inside], told[turn])
            if turn + 1 in scores:
                apart = ~inside
                hits = ((margin > 0) & (y == 1) & apart).sum(), ((margin > 0) & (y == 0) & apart).sum(), ((margin <= 0) & (y == 1) & apart).sum()
                assert tuple(scores[turn + 1][:3, p]) == hits
        assert len(stumps[p]) == len(told)


def numpy_newton(x, y, splits, rounds, rate, depth):
    """Trees grown on rows by exact gains over the same thresholds: margins after each round."""
    margin, out = np.zeros(len(y)), []

    def grow(rows, left_levels):
        g, h = slope[rows].sum(), curve[rows].sum()
        best = (1e-6, None)
        if left_levels:
            for f, thresholds in enumerate(splits):
                for t in thresholds:
                    a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                    ha, hb = curve[a].sum(), curve[b].sum()
                    if ha >= 1 and hb >= 1:
                        gain = slope[a].sum() ** 2 / (ha + 1) + slope[b].sum() ** 2 / (hb + 1) - g * g / (h + 1)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (a, b))
        if best[1] is None:
            margin[rows] += -rate * g / (h + 1)
        else:
            for part in best[1]:
                grow(part, left_levels - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        grow(np.arange(len(y)), depth)
        out.append(margin.copy())
    return out


def test_newton_boosting_equals_rows(spark, labelled):
    from pyspark.ml.functions import vector_to_array

    rows = labelled.select("id", vector_to_array("features").alias("x"), "label")
    splits = cells.candidate_splits(rows, "x", bins=6)
    plans = [newton.Plan(rate, depth, held) for rate in (0.3, 1.2) for depth in (1, 3) for held in (-1, 1)]
    made = cells.cell_table(rows, "x", "label", (F.col("id") % 3).cast("int"), splits, len(plans))
    trees, scores = newton.newton_boosted(made, splits, plans, 12, [2, 12])
    local = labelled.orderBy("id").collect()
    x, y, ids = np.array([r["features"].toArray() for r in local]), np.array([r["label"] for r in local]), np.array([r["id"] for r in local])
    for p, plan in enumerate(plans):
        inside = ids % 3 != plan.held_out
        told = numpy_newton(x[inside], y[inside], splits, 12, plan.rate, plan.depth)
        for n in (1, 2, 12):
            model = newton.NewtonBoostModel(trees[p][:n])
            margin = np.array([r["m"] for r in labelled.orderBy("id").select(model.margin(vector_to_array("features")).alias("m")).collect()])
            assert np.allclose(margin[inside], told[n - 1])
            if n in scores:
                apart = ~inside
                hits = ((margin > 0) & (y == 1) & apart).sum(), ((margin > 0) & (y == 0) & apart).sum(), ((margin <= 0) & (y == 1) & apart).sum()
                assert tuple(scores[n][:3, p]) == hits


def test_newton_grid_and_estimator(labelled, tmp_path):
    found = search.newton_grid([1, 3], [0.3, 1.5], [1, 2], labelled, "id", folds=2)
    assert found.count() == 8
    model = newton.NewtonBoostClassifier(rounds=4, depth=2).fit(labelled)
    assert evaluate.summary(model.transform(labelled))["accuracy"] > 0.85
    search.save_model(model, str(tmp_path / "newton"))
    again = search.load_model(str(tmp_path / "newton")).transform(labelled)
    assert [r["probability"] for r in again.orderBy("id").collect()] == [r["probability"] for r in model.transform(labelled).orderBy("id").collect()]


def test_candidate_splits(spark):
    rows = spark.createDataFrame([([float(i % 3), float(i), 5.0],) for i in range(100)], "x array<double>")
    few, many, one = cells.candidate_splits(rows, "x", bins=4)
    assert few == [0.5, 1.5] and many == [24.75, 49.5, 74.25] and one == []
    found = rows.select(cells.binned("x", [few, many, one]).alias("b"), "x").collect()
    assert all(r["b"] == [int(r["x"][0]), sum(t < r["x"][1] for t in many), 0] for r in found)


def test_registered_queries_have_all_models(spark, monkeypatch):
    from types import SimpleNamespace

    from ledgerlens.catalog import modelling

    asked = []
    monkeypatch.setattr(modelling, "_prices", lambda *_: (None, None))
    monkeypatch.setattr(modelling, "_documents", lambda *_: (None, None))
    monkeypatch.setattr(search, "cross_validated_rmse", lambda train, key, candidates, stages, folds: asked.append((set(candidates), folds)))
    monkeypatch.setattr(search, "compare_feature_sets", lambda train, test, sets, candidates: asked.append((set(candidates), 1)))
    monkeypatch.setattr(search, "boosting_curves", lambda *_, folds: [("AdaBoost", 1.0, 0.5, 0.5), ("GradientBoosting", 1.0, 0.5, 0.5)])
    monkeypatch.setattr(evaluate, "learning_curves", lambda train, key, estimators, *_, folds: [(n, 1.0, 0.5, 0.5) for n in estimators])
    modelling.price_cross_validation(None, None)
    modelling.price_feature_sets(None, None)
    modelling.price_model_errors(None, None)
    five = {"LinearRegression", "DecisionTree", "RandomForest", "GradientBoosting", "KNeighbors"}
    assert asked == [(five, 10), (five, 1), (five, 1)]
    curves = modelling.learning_curve(SimpleNamespace(createDataFrame=lambda rows, schema: rows), None)
    assert {r[0] for r in curves} == set(search.classifiers(4))
