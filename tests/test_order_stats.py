"""Quantiles, ranks, positions and running sums on the paths meant for large data, forced on small data."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators import order_stats as O
from ledgerlens.operators.binning import DuplicateEdges, bin_by_edges, first_rank_bins, quantile_edges


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(1000, 3.0), rng.normal(size=1500), rng.integers(0, 50, 500)]).round(2)
    rng.shuffle(values)
    frame = pd.DataFrame({"id": np.arange(len(values)), "x": values})
    return frame, spark.createDataFrame(frame).persist()


def test_direct_and_narrowing_quantiles_agree_with_pandas(skewed):
    frame, df = skewed
    probs = [0, 0.01, 0.25, 0.5, 0.7, 0.99, 1]
    expected = frame["x"].quantile(probs).tolist()
    assert O.quantiles(df, {"x": probs})["x"] == pytest.approx(expected)
    narrowed = O.quantiles(df, {"x": probs, "id": [0.5]}, direct_rows=0, direct_distinct=0, collect_rows=20)
    assert narrowed["x"] == pytest.approx(expected)
    assert narrowed["id"] == pytest.approx([frame["id"].median()])


def test_values_at_ranks(skewed):
    frame, df = skewed
    ordered = np.sort(frame["x"].to_numpy())
    ranks = [0, 1, 17, 1200, 1201, 2000, 2999]
    found = O.values_at_ranks(df, "x", ranks, collect_rows=5)
    assert [found[r] for r in ranks] == ordered[ranks].tolist()


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert O.quantiles(df, {"x": [0.5]}) == {"x": [None]}


@pytest.mark.parametrize("descending", [False, True])
def test_position_across_ranges(skewed, descending):
    frame, df = skewed
    placed = O.with_position(df, [("x", descending), ("id", False)], rows_per_task=100).toPandas()
    expected = frame.sort_values(["x", "id"], ascending=[not descending, True])["id"].tolist()
    assert placed.sort_values("position")["id"].tolist() == expected
    assert placed["position"].tolist() != [] and sorted(placed["position"]) == list(range(1, len(frame) + 1))


def test_position_within_groups(skewed):
    frame, df = skewed
    grouped = df.withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    placed = O.with_position(grouped, [("x", True), ("id", False)], by=["g"], rows_per_task=100).toPandas()
    frame = frame.assign(g=np.where(frame["id"] % 3 == 0, "a", "b"))
    for g, part in frame.groupby("g"):
        expected = part.sort_values(["x", "id"], ascending=[False, True])["id"].tolist()
        assert placed[placed["g"] == g].sort_values("position")["id"].tolist() == expected


def test_running_sum_across_ranges(skewed):
    frame, df = skewed
    summed = O.with_running_sum(df, [("x", False), ("id", False)], {"id": "upto"}, rows_per_task=100).toPandas()
    ordered = frame.sort_values(["x", "id"])
    expected = dict(zip(ordered["id"], ordered["id"].cumsum()))
    assert dict(zip(summed["id"], summed["upto"])) == expected


def test_top_share(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", float(i)) for i in range(12)], "id long, g string, v double").persist()
    best = O.top_share(df, [("v", True), ("id", False)], 0.2)
    assert sorted(r["id"] for r in best.collect()) == [10, 11]
    within = O.top_share(df, [("v", True), ("id", False)], 0.5, ["g"], "even")
    assert sorted(r["id"] for r in within.collect()) == [3, 4, 8, 9, 10, 11]  # 2.5 rounds to 2, 3.5 to 4


@pytest.mark.parametrize("rows_per_task", [1_000_000, 1])
def test_first_rank_bins_equal_qcut_of_ranks(spark, rows_per_task):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"id": np.arange(203), "x": np.where(rng.random(203) < 0.4, 1, rng.integers(1, 9, 203))})
    df = spark.createDataFrame(frame).persist()
    ours = df.withColumn("bin", first_rank_bins(df, "x", "id", 5, rows_per_task=rows_per_task)).toPandas().sort_values("id")
    expected = pd.qcut(frame["x"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert ours["bin"].tolist() == expected.tolist()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), min_size=6, max_size=40, unique=True))
def test_quantile_bins_equal_qcut(spark, values):
    df = spark.createDataFrame([(v, float(v)) for v in values], "id long, x double")
    edges = quantile_edges(df, ["x"], 5, rows=len(values))["x"]
    ours = {r["id"]: r["bin"] for r in df.withColumn("bin", bin_by_edges(F.col("x"), edges)).collect()}
    expected = pd.qcut(pd.Series(values, dtype=float), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert [ours[v] for v in values] == expected.tolist()


def test_tied_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "x double")
    with pytest.raises(DuplicateEdges):
        quantile_edges(df, ["x"], 4)
    assert quantile_edges(df, ["x"], 4, duplicates="drop")["x"] == [1.0, 3.0]


@pytest.mark.parametrize("rows_per_task", [1_000_000, 10])
def test_nulls_are_placed_last(spark, rows_per_task):
    rows = [(i, None if i % 4 == 0 else float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double").persist()
    for descending in (False, True):
        placed = O.with_position(df, [("x", descending), ("id", False)], rows_per_task=rows_per_task)
        order = [r["id"] for r in placed.orderBy("position").collect()]
        expected = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[0]))
        assert order == [r[0] for r in expected] + [r[0] for r in rows if r[1] is None]


BIG = 2**60  # neighbouring longs here are the same double


def odd_rows():
    rng = np.random.default_rng(3)
    when = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(400):
        x = int(rng.integers(0, 40))
        blank = i % 9 == 0
        rows.append((BIG + i, None if blank else BIG + x, f"k{i:04d}", None if blank else f"v{x % 7}", (when + pd.Timedelta(hours=x)).to_pydatetime(), Decimal(x) / 7))
    rng.shuffle(rows)
    return [(int(a), b if b is None else int(b), c, d, e, Decimal(f)) for a, b, c, d, e, f in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "id long, x long, code string, word string, at timestamp, money decimal(30,10)").persist()


@pytest.mark.parametrize("value", ["x", "word", "at", "money"])
@pytest.mark.parametrize("key", ["id", "code"])
def test_both_plans_agree_in_every_type(odd, value, key):
    answers = []
    for limit in (1_000_000, 20):
        bins = odd.withColumn("bin", first_rank_bins(odd, value, key, 5, rows_per_task=limit)).select("id", "bin").collect()
        up = O.with_position(odd, [(value, False), (key, False)], rows_per_task=limit).select("id", "position").collect()
        down = O.with_position(odd, [(value, True), (key, True)], by=["word"], rows_per_task=limit).select("id", "position").collect()
        sums = O.with_running_sum(odd, [(value, False), (key, False)], {"money": "upto"}, rows_per_task=limit).select("id", "upto").collect()
        best = O.top_share(odd, [(value, True), (key, False)], 0.3, rows_per_task=limit).select("id").collect()
        answers.append([sorted(part) for part in (bins, up, down, sums, best)])
    assert answers[0] == answers[1]


def test_tied_long_keys_fill_bins_evenly(spark):
    df = spark.createDataFrame([(BIG + i, 1) for i in range(1000)], "id long, x int").persist()
    for limit in (1_000_000, 50):
        bins = df.withColumn("bin", first_rank_bins(df, "x", "id", 5, rows_per_task=limit)).groupBy("bin").count().collect()
        assert sorted(r["count"] for r in bins) == [200] * 5


def test_nulls_are_dealt_over_ranges(spark):
    df = spark.createDataFrame([(i, None) for i in range(2000)], "id long, x double")
    ranged = O._ranged(df, [("x", False), ("id", False)], [], 2000, 100)
    assert ranged.groupBy("_range").count().agg(F.max("count")).first()[0] < 500
