"""Steps whose cost must not grow faster than the input, checked by their results and by what they run."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Estimator, Model
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.models import boost, cells, newton, search
from ledgerlens.operators import neighbors
from ledgerlens.plans import basket


def test_deep_trees_are_walked_once(spark):
    """each level once repeated the expression of the level above three times."""
    draw = random.Random(1)
    depth = 8
    trees = [
        newton.Tree(
            [[draw.randrange(3) for _ in range(1 << level)] for level in range(depth)],
            [[draw.choice([draw.random(), math.inf]) for _ in range(1 << level)] for level in range(depth)],
            [draw.random() for _ in range(1 << depth)],
        )
        for _ in range(3)
    ]
    rows = [(i, [draw.random(), draw.choice([None, draw.random(), math.nan]), draw.choice([math.inf, draw.random()])]) for i in range(40)] + [(99, None)]
    margin = newton.NewtonBoostModel(trees).margin(F.col("x"))
    assert str(margin).count("greatest") == 0 and len(str(margin)) < 20_000 + len(str(trees))
    told = dict(spark.createDataFrame(rows, "id int, x array<double>").select("id", margin).collect())
    for i, x in rows:
        total = 0.0
        for t in trees:
            node = 0
            for features, thresholds in zip(t.features, t.thresholds):
                value, limit = x and x[features[node]], min(thresholds[node], 1.7976931348623157e308)
                node = 2 * node + (value is not None and (math.isnan(value) or value > limit))
            total += t.leaves[node]
        assert told[i] == pytest.approx(total, abs=1e-12)


def _boosting_cells(spark, plans):
    draw = random.Random(3)
    rows = [(i, [float(draw.randrange(9)), float(draw.randrange(4)), draw.random()]) for i in range(300)]
    df = spark.createDataFrame([(i, x, float(x[0] + draw.random() * 4 > 6)) for i, x in rows], "id int, x array<double>, label double")
    splits = cells.candidate_splits(df, "x", 8)
    return cells.cell_table(df, "x", "label", F.col("id") % 3, splits, plans, F.col("id") % 2), splits


def _refused(*_):
    raise AssertionError("a job for a round")


@pytest.mark.parametrize("kind", ["newton", "boost"])
def test_few_cells_cost_no_job_a_round(spark, monkeypatch, kind):
    """200 rounds of five levels were 1,000 jobs whatever the size."""
    if kind == "newton":
        plans = [newton.Plan(rate, depth, fold, band=band) for rate in (0.3, 1.0) for depth in (1, 3) for fold in range(3) for band in (0, 1)]
        run = newton.newton_boosted
    else:
        plans = [boost.Plan(rate, by_label, fold, band) for rate in (0.5, 1.0) for by_label in (True, False) for fold in range(3) for band in (0, 1)]
        run = boost.boosted
    monkeypatch.setattr(cells, "HELD_CELLS", 0)
    table, splits = _boosting_cells(spark, len(plans))
    *by_jobs, scores = run(table, splits, plans, 12, [5, 12])
    monkeypatch.setattr(cells, "HELD_CELLS", 1 << 16)
    monkeypatch.setattr(cells, "summed", _refused)
    table, splits = _boosting_cells(spark, len(plans))
    *held, held_scores = run(table, splits, plans, 12, [5, 12])
    assert {n: v.tolist() for n, v in scores.items()} == {n: v.tolist() for n, v in held_scores.items()}
    if kind == "newton":
        for a, b in zip(by_jobs[0], held[0], strict=True):
            assert [t.features for t in a] == [t.features for t in b] and [t.thresholds for t in a] == [t.thresholds for t in b]
            assert [v for t in a for v in t.leaves] == pytest.approx([v for t in b for v in t.leaves], abs=1e-9)
    else:
        assert by_jobs[1] == [pytest.approx(v) for v in held[1]]
        for a, b in zip(by_jobs[0], held[0], strict=True):
            assert [(s.feature, s.threshold) for s in a] == [(s.feature, s.threshold) for s in b]


def test_wide_flags_are_shuffled_as_bits(spark):
    """25 columns of an invoice were gathered side by side."""
    rows = [("1", "a"), ("1", "b"), ("2", None), ("3", "other"), ("4", "c70"), ("4", None), (None, "a")]
    pairs = spark.createDataFrame(rows, "invoice string, item string")
    items = ["a", "b", *[f"c{k}" for k in range(100)]]
    found = basket.basket_flags(pairs, items)
    plain = pairs.groupBy("invoice").agg(*[F.max((F.col("item") == i).cast("int")).alias(i) for i in items])
    assert found.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("bit_or(") == 2


@pytest.mark.parametrize("spread", ["even", "steps", "hub"])
def test_cells_of_a_tree_hold_every_neighbour(spark, spread):
    """F6 to F8, F10: rows were compared with a number of pivots that grew with the rows."""
    draw = random.Random(spread)
    value = {
        "even": lambda: [draw.random() for _ in range(3)],
        "steps": lambda: [float(draw.randrange(4)), float(draw.randrange(3)), 0.0],
        "hub": lambda: [0.5, 0.5, draw.random()] if draw.random() < 0.7 else [draw.gauss(0, 9) for _ in range(3)],
    }[spread]
    rows = [(i, *value()) for i in range(700)] + [(900 + i, math.nan, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    found = {r["id"]: [(n["id"], n["distance"]) for n in r["neighbours"]] for r in neighbors.nearest(df, df, ["a", "b", "c"], 6, "id", True, points_per_cell=10, block_rows=40).collect()}
    whole = [r for r in rows if r[0] < 900]
    assert set(found) == {r[0] for r in whole}
    for i, *v in whole:
        best = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), j) for j, *w in whole if j != i)[:6]
        assert [j for j, _ in found[i]] == [j for _, j in best]
        assert [d for _, d in found[i]] == pytest.approx([d for d, _ in best])
    assert not hasattr(neighbors, "_pivots")


def test_rows_of_a_fit_lie_in_few_partitions(spark):
    """every pass of a fit had tasks for partitions without rows."""
    rows = spark.range(1_000).repartition(12).withColumn("label", (F.col("id") % 2).cast("double"))
    assert session.gathered(rows).rdd.getNumPartitions() == 1
    parted = session.gathered(rows, 300)
    assert parted.rdd.getNumPartitions() == 4 and sorted(parted.collect()) == sorted(rows.collect())


def test_pairs_are_gathered_by_invoice(spark):
    """pairs and invoices were shuffled into as many partitions whatever their number."""
    draw = random.Random(5)
    rows = [(draw.choice(["1", "2", "3", None]), draw.choice(["a", "b", None]), draw.choice(["POST", "x", None]), draw.choice([-2, 1, 2, None])) for _ in range(80)]
    lines = spark.createDataFrame(rows, "invoice string, item string, stock_code string, quantity long")
    dealt = basket.basket_items(lines, "item", parts=5)
    flags = basket.basket_flags(dealt, ["a", "b"])
    assert sorted(dealt.collect()) == sorted(basket.basket_items(lines, "item").collect())
    assert flags.rdd.getNumPartitions() == 5  # those dealt, so not shuffled again


@pytest.mark.parametrize("shape", ["steps", "even", "copies", "endless"])
def test_rows_of_a_cell_are_not_all_compared(monkeypatch, shape):
    """a query was compared with every point of the cells it visited, whose size grew with the rows."""
    rng = np.random.default_rng(4)
    points = np.column_stack([rng.random(6_000) / 20, rng.integers(0, 9, 6_000) / 2.6])
    if shape == "even":
        points = rng.random((6_000, 3))
    elif shape == "copies":
        points[:, 0] = np.round(points[:, 0], 3)
    asked = points[rng.integers(0, 6_000, 500)] + rng.integers(0, 2, (500, 1)) * 0.001
    if shape == "endless":
        points[:3, 0], points[3, 1], asked[0], asked[1, 0] = math.inf, math.nan, math.nan, -math.inf
    bound = np.where(rng.random(500) < 0.5, np.inf, 0.02)
    compared, lengths = [], neighbors._lengths

    def counted(differences):
        found = lengths(differences)
        compared.append(found.size)
        return found

    monkeypatch.setattr(neighbors, "_lengths", counted)
    row, column, distance = neighbors._closest(points, asked, bound, 6)
    assert sum(compared) < 500 * 6_000 / 10
    with np.errstate(invalid="ignore"):
        every = neighbors._distances(asked, points)
    for i in range(500):
        at = [j for j in np.lexsort((np.arange(6_000), every[i])) if every[i, j] <= bound[i]][:6]
        assert column[row == i].tolist() == at and distance[row == i].tolist() == every[i, at].tolist()


def test_feature_sets_keep_no_spent_columns(spark):
    """rows of every set were held with all columns that had gone into the vector."""
    seen = []

    class Told(Model):
        def _transform(self, dataset):
            seen.append(set(dataset.columns))
            return dataset.withColumn("prediction", F.col("label"))

    class Fit(Estimator):
        def _fit(self, dataset):
            seen.append(set(dataset.columns))
            return Told()

    rows = [(i, float(i), float(i % 3), "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, label double")
    found = search.compare_feature_sets(df, df, {"all": (["a", "b"], ["c"]), "one": (["a"], [])}, {"told": Fit()})
    assert seen == [{"id", "label", "features"}] * 4 and found.count() == 2


def test_mean_of_neighbours_by_distinct_vector(spark):
    """labels met every row's neighbours; rows that share a vector or a key keep their means."""
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 2.0), (3, 9.0, 30.0), (3, 9.5, None), (4, 10.0, 50.0)], "id long, x double, label double")
    asked = spark.createDataFrame([(10, 0.1), (11, 0.1), (12, 9.1), (13, 9.9), (13, 9.9), (None, 0.1)], "id long, x double")
    vector = search.feature_stages(["x"], scale=False)[0]
    model = search.NearestMeanRegressor("id", 2).fit(vector.transform(points))
    told = sorted((r["id"] or 0, r["x"], r["prediction"]) for r in model.transform(vector.transform(asked)).collect())
    assert told == [(0, 0.1, None), (10, 0.1, 1.5), (11, 0.1, 1.5), (12, 9.1, 30.0), (13, 9.9, 40.0), (13, 9.9, 40.0)]
