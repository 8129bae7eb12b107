"""Baskets and recommenders against brute force."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import basket, content, recommend


@pytest.fixture(scope="module")
def baskets(spark):
    rng = np.random.default_rng(4)
    rows = {i: set(rng.choice(list("abcdefg"), size=rng.integers(1, 6), replace=False)) for i in range(60)}
    lines = [(str(i), str(x), 1, "G", str(x)) for i, items in rows.items() for x in items] + [("0", "POST", 1, "G", "POST"), ("999", "a", 1, "F", "a")]
    return rows, spark.createDataFrame(lines, "invoice string, item string, quantity int, country string, stock_code string").persist()


def _support(rows, items):
    return sum(set(items) <= b for b in rows.values()) / len(rows)


def test_sets_and_rules_equal_brute_force(baskets):
    rows, lines = baskets
    pairs = basket.basket_items(lines, "item", "G")
    sets = basket.frequent_sets(pairs, 0.1)
    expected = {c: _support(rows, c) for k in range(1, 8) for c in combinations("abcdefg", k) if _support(rows, c) >= 0.1}
    assert {tuple(r["items"]): pytest.approx(r["support"]) for r in sets.collect()} == expected
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in basket.association_rules(sets, 0.1).collect()}
    splits = {(a, tuple(sorted(set(s) - set(a)))) for s in expected for k in range(1, len(s)) for a in combinations(s, k)}
    assert set(rules) == splits
    for (a, c), r in rules.items():
        both = _support(rows, a + c)
        assert r["confidence"] == pytest.approx(both / _support(rows, a))
        assert r["lift"] == pytest.approx(both / _support(rows, a) / _support(rows, c))
        assert r["leverage"] == pytest.approx(both - _support(rows, a) * _support(rows, c))


def test_certain_rule_has_infinite_conviction(spark):
    lines = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "b")], "invoice string, item string")
    rules = {(r["antecedents"][0], r["consequents"][0]): r["conviction"] for r in basket.association_rules(basket.frequent_sets(lines, 0.3)).collect()}
    assert rules[("a", "b")] == float("inf") and rules[("b", "a")] == pytest.approx((1 - 2 / 3) / (1 - 2 / 3))


def test_no_frequent_item(spark):
    lines = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "invoice string, item string")
    assert basket.frequent_sets(lines, 0.9).count() == 0


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(6)
    rows = [(u, f"t{t}", float(rng.integers(1, 6)), pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(rng.integers(0, 300)))) for u in range(40) for t in range(12) if rng.random() < 0.7]
    frame = pd.DataFrame(rows, columns=["user_id", "title", "rating", "ts"])
    return frame, spark.createDataFrame(frame).persist()


def test_user_based_equals_pandas(rated):
    frame, df = rated
    titles = recommend.user_titles(df, 5).persist()
    wide = frame.groupby("title").filter(lambda g: len(g) > 5).pivot_table(index="user_id", columns="title", values="rating")
    own = wide.loc[3].dropna()
    part = wide[own.index]
    counts = part.notna().sum(axis=1)
    corr = part.T.corrwith(own)
    near = corr[(counts > 5) & (corr >= 0.3) & (corr.index != 3)]
    ours = {r["user_id"]: r["corr"] for r in recommend.neighbours(titles, 3, 0.3, more_than=5).collect()}
    assert ours == pytest.approx(near.to_dict())
    weighted = frame[frame["user_id"].isin(near.index)].assign(w=lambda f: f["rating"] * f["user_id"].map(near))
    expected = weighted.groupby("title")["w"].mean().to_dict()
    scores = recommend.user_based_scores(df, recommend.neighbours(titles, 3, 0.3, more_than=5))
    assert {r["title"]: r["score"] for r in scores.collect()} == pytest.approx(expected)


def test_item_based_equals_pandas(rated):
    frame, df = rated
    titles = recommend.user_titles(df, 5).persist()
    wide = frame.pivot_table(index="user_id", columns="title", values="rating")
    expected = wide.corrwith(wide["t4"]).dropna().to_dict()
    ours = {r["title"]: r["corr"] for r in recommend.title_correlations(titles, F.lit("t4")).collect()}
    assert ours == pytest.approx(expected)
    assert recommend.item_based(titles, F.lit("t4"), 3, include_seed=True).orderBy("position").first()["title"] == "t4"


def test_seed_is_latest_best_and_missing_seed_gives_nothing(spark):
    rows = [(1, "a", 5.0, "2020-01-01"), (1, "b", 5.0, "2020-03-01"), (1, "c", 4.0, "2020-05-01"), (2, "a", 3.0, "2020-01-01")]
    df = spark.createDataFrame(rows, "user_id long, title string, rating double, ts string")
    titles = recommend.user_titles(df, 0)
    assert df.select(recommend.seed_title(df, titles, 1).alias("s")).first()["s"] == "b"
    assert df.select(recommend.seed_title(df, recommend.user_titles(df, 1), 1).alias("s")).first()["s"] == "a"  # b is not popular
    assert recommend.item_based(titles, recommend.seed_title(df, titles, 2), 5).count() == 0


def test_similar_texts(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "apple pie"), (3, "blue sky"), (4, None), (5, "The Apple, of")], "id int, text string")
    found = content.similar_texts(docs, "id", "text", 1).collect()
    assert [r["id"] for r in found] == [2, 5]
    n = 5
    idf = {t: np.log((1 + n) / (1 + d)) + 1 for t, d in {"red": 1, "apple": 3, "pie": 2}.items()}
    dot = idf["apple"] ** 2 + idf["pie"] ** 2
    assert found[0]["score"] == pytest.approx(dot / np.sqrt(dot) / np.sqrt(dot + idf["red"] ** 2))
    assert content.similar_texts(docs, "id", "text", 4).count() == 0


def test_lines_are_shuffled_by_order_and_part_alone(spark):
    from ledgerlens.plans import rfm
    from ledgerlens.sources import views

    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "2000"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        lines = rfm.clean_lines(views.retail_lines(spark, "/root/testdata/sf0.001", sold_only=True))
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    joins = [x for x in plan.splitlines() if "SortMergeJoin" in x]
    assert len(joins) == 4 and sum("l_orderkey" in x or "l_partkey" in x for x in joins) == 2
    assert "Or(IsNull(l_returnflag),Not(EqualTo(l_returnflag,R)))" in plan
    assert "IsNotNull(p_name)" in plan and "IsNotNull(o_orderdate)" in plan and "IsNotNull(n_name)" in plan
