"""Cleaning, scalar helpers, binning, profiling, outliers, missing values and encoding on hand-made rows."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.functions import special
from ledgerlens.operators import binning, clean, encode, missing, outliers, profile
from ledgerlens.plans import basket, cltv, levels, records, rfm
from ledgerlens.sources import tables


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_cancellation_mark_anywhere_and_missing(spark):
    df = spark.createDataFrame([("C1",), ("1C2",), ("12",), (None,)], "invoice string")
    assert values(clean.drop_cancelled(df), "invoice") == ["12", None]


def test_dropping_rows_keeps_unknown(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double")
    assert values(clean.drop_matching(df, F.col("x") == 0)) == [1.0, None]


def test_zero_report(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0), (None, 4.0)], "a double, b double")
    found = {r["column"]: (r["has_zero"], r["converted"]) for r in clean.zero_report(df, ["a", "b"]).collect()}
    assert found == {"a": (True, 2), "b": (False, 0)}
    assert values(clean.zeros_to_null(df, ["a"]), "a") == [None, 2.0, None]


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in clean.keep_last(df, ["k"], "o").collect()} == {("a", None), ("b", "z")}
    assert {(r["k"], r["v"]) for r in clean.first_per_key(df, "k", "v", ["o"]).collect()} == {("a", "x"), ("b", "z")}


def test_pick_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert values(clean.pick_one(df, "k", 7), "k") == values(clean.pick_one(df.repartition(5), "k", 7), "k")


def test_whole_days_floor_elapsed_time(spark):
    row = spark.createDataFrame([(dt.datetime(2011, 12, 10, 15), dt.datetime(2011, 12, 11))], "a timestamp, b timestamp")
    assert row.select(X.whole_days(F.col("b"), F.col("a")).alias("x")).first()["x"] == 0
    assert row.select(X.whole_days(F.col("a"), F.col("b")).alias("x")).first()["x"] == -1


def test_parsing_and_mapping(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("",), ("x",), (None,)], "t string")
    assert values(df.select(X.parsed_number(F.col("t")).alias("x"))) == [1.5, None, None, None]
    assert values(df.select(X.recoded(F.col("t"), {"x": 1}).alias("x"))) == [None, None, 1, None]
    assert values(df.select(X.yes_no_flag(F.col("t") == "x").alias("x"))) == [0, 0, 1, 0]


def test_nested_literals(spark):
    rows = [
        ("[{'id': 1, 'name': 'Drama'}, {'id': 2, 'name': 'Comedy'}]", "Drama, Comedy"),
        ("{'name': \"Ocean's\", 'poster': None}", "Ocean's"),
        ("[{'name': 'None True', 'a': False}]", "None True"),
        ("[]", ""),
        ("broken", None),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "t string, e string")
    for r in df.select("e", X.joined_names(F.col("t")).alias("x")).collect():
        assert r["x"] == r["e"]


def test_records_cleaned(spark):
    base = {c: "1" for c in records.KEPT_COLUMNS} | {c: "[{'name':'a'}]" for c in records.NESTED_COLUMNS}
    rows = [
        base | {"id": "2", "adult": "False", "belongs_to_collection": None, "release_date": "1999-01-02", "genres": "junk"},
        base | {"id": "1", "adult": "True", "release_date": ""},
    ]
    schema = ", ".join(f"{c} string" for c in (*records.KEPT_COLUMNS, "adult"))
    out = records.clean_records(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 1
    assert (out[0]["belongs_to_collection"], out[0]["genres"], out[0]["unreadable"]) == ("No", None, 1)
    assert out[0]["release_date"] == dt.datetime(1999, 1, 2)


def test_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 6, 7)], "x double").persist()
    assert values(binning.quantile_bins(df, "x", 5, name="b"), "b") == pd.qcut(range(1, 8), 5, labels=[1, 2, 3, 4, 5]).tolist()
    fixed = df.select(binning.fixed_bins(F.col("x"), (1, 3, 5), ("low", "high")).alias("x"))
    assert values(fixed) == [None, "low", "low", "high", "high", None, None]
    counts = [1, 2, 2, 5, 9, 33, 54]
    wide = spark.createDataFrame([(v,) for v in counts], "x int")
    ours = wide.select(binning.equal_width_bin(F.col("x"), F.lit(1), F.lit(54), 100).alias("x"))
    assert values(ours) == pd.cut(pd.Series(counts), 100, labels=range(1, 101)).astype(int).tolist()
    equal = wide.select(binning.equal_width_bin(F.lit(4), F.lit(4), F.lit(4), 100).alias("x"))
    assert set(values(equal)) == {50}
    ages = spark.createDataFrame([(18,), (19,), (66,), (67,), (101,)], "x int")
    assert values(ages.select(binning.age_band(F.col("x"), levels.AGE_BANDS).alias("x"))) == ["0_18", "19_23", "41_66", "67_100", None]


def test_level_lookup(spark):
    spending = spark.createDataFrame([("A_M", 10.0), ("A_M", 20.0), ("B_F", 30.0), ("C_F", 50.0), ("D_F", 70.0), ("E_F", 90.0)], "k string, p double")
    table = levels.level_table(spending, "k", "p")
    users = spark.createDataFrame([(1, "A_M"), (2, "X")], "id int, k string")
    found = {r["id"]: (r["price"], r["segment"], r["has_data"]) for r in levels.looked_up(users, table, "k").collect()}
    assert found == {1: (15.0, "D", True), 2: (None, None, False)}


def test_fences_and_clipping(spark):
    data = [float(v) for v in range(1, 100)] + [5000.0, None]
    df = spark.createDataFrame([(v,) for v in data], "x double").persist()
    low, high = outliers.fences(df, ["x"], outliers.WIDE_QUANTILES)["x"]
    series = pd.Series(data)
    q1, q3 = series.quantile(0.05), series.quantile(0.95)
    assert (low, high) == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    clipped = values(outliers.clip(df, {"x": (low, high)}))
    assert max(v for v in clipped if v is not None) == high and clipped[-1] is None
    assert outliers.remove_outliers(df, "x", outliers.WIDE_QUANTILES).count() == 100
    assert values(outliers.outlier_rows(df, "x", outliers.WIDE_QUANTILES)) == [5000.0]
    assert outliers.outlier_check(df, ["x"], outliers.WIDE_QUANTILES).first()["has_outliers"]


def test_correlation_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0), (4.0, 7.9, 5.0)], "a double, b double, c double")
    found = {(r["column_a"], r["column_b"]): r["corr"] for r in profile.correlations(df, ["a", "b", "c"]).collect()}
    assert found[("a", "b")] == pytest.approx(df.toPandas()[["a", "b"]].corr().iloc[0, 1])
    assert found[("a", "c")] is None
    assert profile.correlations(df.limit(1), ["a", "b"]).first()["corr"] is None
    assert values(profile.correlated_columns(df, ["a", "b", "c"], 0.9), "column") == ["b"]


def test_profile_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "x double, t string")
    found = {(r["column"], r["metric"]): r["value"] for r in profile.table_profile(df).collect()}
    assert found[("x", "nulls")] == 2 and found[("x", "q0.5")] is None and found[("*", "rows")] == 2
    assert profile.histogram(df, "x").count() == 0
    assert profile.table_profile(df.limit(0)).count() > 0


def test_column_groups(spark):
    df = spark.createDataFrame([(i, i % 3, f"v{i % 2}", f"u{i}") for i in range(40)], "n int, small int, t string, u string")
    groups = profile.column_groups(df)
    assert groups.number == ["n"] and groups.number_as_category == ["small"]
    assert groups.category == ["t", "small"] and groups.high_cardinality == ["u"]


def test_missing_reports(spark):
    df = spark.createDataFrame([(1.0, None, 1), (None, None, 0), (3.0, "a", 1)], "a double, b string, y int")
    rows = [(r["column"], r["n_miss"], r["ratio"]) for r in missing.missing_report(df).collect()]
    assert rows == [("b", 2, 66.67), ("a", 1, 33.33)]
    assert missing.missing_columns(df) == ["b", "a"]
    flags = {(r["column"], r["missing"]): (r["target_mean"], r["count"]) for r in missing.missing_against_target(df, "y", ["a"]).collect()}
    assert flags == {("a", 0): (1.0, 2), ("a", 1): (0.0, 1)}


def test_encoding(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("b",)], "t string")
    hot = encode.one_hot(df)
    assert hot.columns == ["t_b"] and values(hot, "t_b") == [1, 0, 0, 1, 1]
    assert values(encode.label_encoded(df, ["t"]), "t") == [1, 0, None, 1, 1]
    assert sorted(map(str, values(encode.rare_encoded(df, 0.3), "t"))) == ["None", "Rare", "b", "b", "b"]


def test_scaling_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    for scaled in (
        encode.robust_scaled(df, ["x", "c"]),
        encode.standard_scaled(df, ["x", "c"]),
        encode.min_max_scaled(df, encode.min_max_parameters(df, ["x", "c"])),
    ):
        assert values(scaled, "c") == [0.0, 0.0]


def test_segments_cover_all_codes(spark):
    codes = spark.createDataFrame([(f"{r}{f}",) for r in range(1, 6) for f in range(1, 6)], "rfm_score string")
    names = values(rfm.with_segment(codes), "segment")
    assert set(names) == set(rfm.SEGMENTS.values()) and len(names) == 25
    assert "at_Risk" in values(rfm.with_segment(codes, rfm.segment_names(short=True)), "segment")


def test_value_without_churn_is_null(spark):
    lines = spark.createDataFrame(
        [("1", 1, 2, 3.0), ("2", 1, 1, 3.0), ("3", 2, 1, 4.0), ("4", 2, 1, 4.0)], "invoice string, customer_id long, quantity long, price double"
    )
    out = cltv.calculated_value(lines).collect()
    assert len(out) == 2 and all(r["cltv"] is None and r["segment"] is None for r in out)


def test_ragged_batches(spark):
    both = tables.appended([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")])
    assert sorted(map(tuple, both.collect())) == [(1, None), (2, "x")]


def test_described_groups(spark):
    rng = np.random.default_rng(12)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 60), "x": rng.normal(size=60), "y": rng.integers(0, 9, 60)})
    out = {(r["g"], r["column"]): r for r in rfm.described(spark.createDataFrame(frame), ["x", "y"], "g").collect()}
    for (g, c), r in out.items():
        d = frame[frame["g"] == g][c].describe()
        assert [r[k] for k in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(d.tolist())
    assert len(out) == 4


def test_many_groups_are_described(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.integers(0, 150, 1500), "x": rng.normal(size=1500).round(1)})
    expected = frame.groupby("g")["x"].describe()
    for r in rfm.described(spark.createDataFrame(frame), ["x"], "g").collect():
        found = [r["n"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert found == pytest.approx(expected.loc[r["g"]].tolist(), nan_ok=True)


def test_all_outliers_come_back(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(1000)] + [(1000.0 + i,) for i in range(12)], "x double")
    assert outliers.outlier_rows(df, "x", outliers.WIDE_QUANTILES).count() == 12


def test_distinct_counts_are_exact_unless_asked(spark):
    df = spark.createDataFrame([(i, str(i % 30)) for i in range(5000)], "a long, b string")
    assert profile.distinct_counts(df) == {"a": 5000, "b": 30}
    assert profile.few_distinct(df, 30) == {"a": None, "b": 30} and profile.few_distinct(df, 29) == {"a": None, "b": None}


def test_labels_of_many_levels(spark):
    df = spark.createDataFrame([(i, f"t{i:05d}", None if i % 2 else "u") for i in range(12_000)], "id long, t string, u string")
    found = encode.label_encoded(df, ["t", "u"])
    assert found.columns == ["id", "t", "u"]
    assert found.where("t <> id OR (u IS NULL) <> (id % 2 = 1) OR u <> 0").count() == 0


def test_hypergeometric_near_one():
    z = np.array([0.5, 0.9, 0.9999, 0.99999])
    assert special.hypergeometric_2f1(1.0, 1.0, 2.0, z) == pytest.approx(-np.log1p(-z) / z, rel=1e-9)
    with pytest.raises(ArithmeticError):
        special.hypergeometric_2f1(1.0, 1.0, 2.0, 0.999, limit=50)
    with pytest.raises(ValueError):
        special.hypergeometric_2f1(1.0, 1.0, 2.0, 1.0)


def test_rules_of_a_long_set(spark):
    items = [f"i{k:02d}" for k in range(14)]
    sets = [(sorted(c), 1.0) for n in range(1, 15) for c in itertools.combinations(items, n) if n in (1, 13, 14)]
    rules = basket.association_rules(spark.createDataFrame(sets, "items array<string>, support double"))
    whole = [r for r in rules.collect() if len(r["antecedents"]) + len(r["consequents"]) == 14]
    assert len(whole) == 28  # of all splits of the set of 14, those whose parts have a support here
