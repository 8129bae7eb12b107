"""Scores against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scores as S

Z = S.two_sided_z(0.95)


def test_normal_quantile():
    assert Z == pytest.approx(1.959963984540054)


def test_votes(spark):
    df = spark.createDataFrame([(600, 400), (0, 0), (0, 5)], "up int, down int")
    rows = df.select(S.up_share(F.col("up"), F.col("down")).alias("s"), S.wilson_lower_bound(F.col("up"), F.col("down")).alias("w")).collect()
    p, n = 0.6, 1000
    wilson = (p + Z * Z / (2 * n) - Z * math.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    assert (rows[0]["s"], rows[0]["w"]) == pytest.approx((0.6, wilson))
    assert (rows[1]["s"], rows[1]["w"]) == (0.0, 0.0)
    assert rows[2]["s"] == 0.0 and rows[2]["w"] == pytest.approx(0.0, abs=1e-12)


def test_stars(spark):
    counts = [(0, 0, 0, 0, 0), (1, 2, 3, 4, 10)]
    df = spark.createDataFrame(counts, "a int, b int, c int, d int, e int")
    none, some = [r["x"] for r in df.select(S.bayesian_average_rating([F.col(c) for c in "abcde"]).alias("x")).collect()]
    n, k = 20, 5
    first = sum((i + 1) * (c + 1) / (n + k) for i, c in enumerate(counts[1]))
    second = sum((i + 1) ** 2 * (c + 1) / (n + k) for i, c in enumerate(counts[1]))
    assert none == 0.0
    assert some == pytest.approx(first - Z * math.sqrt((second - first**2) / (n + k + 1)))


def test_empty_band_makes_the_mean_null(spark):
    full = [(4.0, 10), (3.0, 60), (5.0, 100), (2.0, 400)]
    df = spark.createDataFrame(full, "r double, d int")
    expression = S.time_weighted_mean(F.col("r"), F.col("d")).alias("x")
    assert df.agg(expression).first()["x"] == pytest.approx(4 * 0.28 + 3 * 0.26 + 5 * 0.24 + 2 * 0.22)
    assert df.filter("d <> 60").agg(expression).first()["x"] is None


def test_shrunk_rating(spark):
    df = spark.createDataFrame([(8.0, 100, 300, 6.0), (8.0, 0, 0, 6.0)], "r double, v int, m int, c double")
    got = [r["x"] for r in df.select(S.shrunk_rating(F.col("r"), F.col("v"), F.col("m"), F.col("c")).alias("x")).collect()]
    assert got == [pytest.approx(6.5), None]
