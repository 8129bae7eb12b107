"""Predictions against published figures, and fits against simulated customers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.special import hypergeometric_2f1, log_gamma
from ledgerlens.plans import probabilistic as P

# Parameters solved from the published figures below; the values over 6 months were held out of the solution.
PURCHASES = P.PurchaseModel(r=2.21329634, alpha=11.66047454, a=0.1171808, b=2.50567782)
PROFIT = P.ProfitModel(p=1.0, q=1.0 - 0.17093698, v=3.74948908)

# customer, recency days, age days, frequency, monetary, purchases in 1 and 4 weeks, profit, value over 6 months
KNOWN = [
    (12747, 366, 370, 11, 381.455455, 0.202475, 0.807661, 387.822977, 1937.009093),
    (12748, 372, 374, 209, 154.564163, 3.237513, 12.915924, 154.708635, 12366.071920),
    (12749, 209, 214, 5, 814.488000, 0.167144, 0.665709, 844.095338, 3445.922970),
    (12820, 323, 327, 4, 235.585000, 0.103970, 0.414561, 247.081182, 631.934113),
    (12822, 16, 88, 2, 474.440000, 0.129143, 0.512661, 520.829235, 1612.132952),
]
HORIZONS = [(15601, 361, 373, 14, 484.04, 518.424707, 5695.407853), (16000, 0, 3, 3, 2055.786667, 3843.408761, 39233.195047)]


def test_predictions_match_published_figures(spark):
    df = spark.createDataFrame(KNOWN, "id long, rd int, td int, frequency long, monetary double, w1 double, w4 double, profit double, clv6 double")
    df = df.withColumns({"recency": F.col("rd") / 7, "age": F.col("td") / 7})
    seen = [F.col(c) for c in ("frequency", "recency", "age")]
    out = P.with_lifetime_value(df, PURCHASES, PROFIT, [6]).withColumns(
        {
            "p1": P.expected_purchases(PURCHASES, 1, *seen),
            "p4": P.expected_purchases(PURCHASES, 4, *seen),
            "m": P.expected_profit(PROFIT, F.col("frequency"), F.col("monetary")),
        }
    )
    for row in out.collect():
        assert row["p1"] == pytest.approx(row["w1"], rel=1e-5)
        assert row["p4"] == pytest.approx(row["w4"], rel=1e-5)
        assert row["m"] == pytest.approx(row["profit"], rel=1e-5)
        assert row["clv_6m"] == pytest.approx(row["clv6"], rel=1e-5)


def test_horizons_match_published_figures(spark):
    df = spark.createDataFrame(HORIZONS, "id long, rd int, td int, frequency long, monetary double, c1 double, c12 double")
    df = df.withColumns({"recency": F.col("rd") / 7, "age": F.col("td") / 7})
    for row in P.with_lifetime_value(df, PURCHASES, PROFIT, [1, 12]).collect():
        assert row["clv_1m"] == pytest.approx(row["c1"], rel=1e-5)
        assert row["clv_12m"] == pytest.approx(row["c12"], rel=1e-5)


def test_published_scaling_is_linear():
    raw = {18102: 14884.500498, 14096: 9855.142320, 17450: 8434.507606}
    scaled = {18102: 1.0, 14096: 0.662108, 17450: 0.566664}
    slope = (scaled[18102] - scaled[17450]) / (raw[18102] - raw[17450])
    assert scaled[17450] + slope * (raw[14096] - raw[17450]) == pytest.approx(scaled[14096], abs=2e-6)


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 2.5, 10.0, 300.0])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    # 2F1(1, 1; 2; z) = -ln(1 - z) / z
    z = np.array([0.1, 0.5, 0.9])
    assert hypergeometric_2f1(1, 1, 2, z) == pytest.approx(-np.log(1 - z) / z, rel=1e-10)


def _simulated(n=4000, r=0.8, alpha=6.0, a=0.9, b=2.5, seed=7):
    rng = np.random.default_rng(seed)
    age = rng.integers(20, 60, n).astype(float)
    rate, drop = rng.gamma(r, 1 / alpha, n), rng.beta(a, b, n)
    rows = []
    for i in range(n):
        t, x, tx = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / rate[i])
            if t > age[i]:
                break
            x, tx = x + 1, t
            if rng.random() < drop[i]:
                break
        rows.append((i, x, tx, age[i]))
    return pd.DataFrame(rows, columns=["customer_id", "frequency", "recency", "age"])


def test_purchase_fit_recovers_simulated_customers(spark):
    model = P.fit_purchases(spark.createDataFrame(_simulated()), penalty=0.0)
    assert model.r == pytest.approx(0.8, rel=0.15)
    assert model.r / model.alpha == pytest.approx(0.8 / 6.0, rel=0.1)
    assert model.a / (model.a + model.b) == pytest.approx(0.9 / 3.4, rel=0.2)


def test_profit_fit_recovers_simulated_customers(spark):
    rng = np.random.default_rng(3)
    n, p, q, v = 6000, 6.0, 4.0, 15.0
    x = rng.integers(1, 15, n)
    rate = rng.gamma(q, 1 / v, n)
    m = rng.gamma(p * x, 1 / (rate * x))
    model = P.fit_profit(spark.createDataFrame(pd.DataFrame({"frequency": x, "monetary": m})), penalty=0.0)
    assert model.p * model.v / (model.q - 1) == pytest.approx(p * v / (q - 1), rel=0.1)
    assert model.q == pytest.approx(q, rel=0.15)
