"""Probabilistic lifetime value: purchases by the BG/NBD model, profit by the Gamma-Gamma model.

Fader, Hardie and Lee (2005), "Counting Your Customers" the Easy Way; Fader and Hardie (2013), The Gamma-Gamma Model of
Monetary Value. Times are in weeks. Customers never leave the executors: they are collapsed to distinct
(frequency, recency, age) rows with counts, and each step of the fit is a sum over those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import whole_days
from ledgerlens.functions.special import hypergeometric_2f1, log_gamma
from ledgerlens.plans.cltv import min_max_scaled, with_value_segment
from ledgerlens.plans.rfm import line_total
from ledgerlens.session import reused, spread

WEEKS_PER_MONTH = 4.345
_OTHER_LENGTHS = (2.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


@dataclass(frozen=True)
class PurchaseModel:
    """BG/NBD parameters, time in weeks."""

    r: float
    alpha: float
    a: float
    b: float


@dataclass(frozen=True)
class ProfitModel:
    """Gamma-Gamma parameters."""

    p: float
    q: float
    v: float


def lifetime_features(lines: DataFrame, today: Column, repeat_only: bool = False) -> DataFrame:
    """Recency (first to last invoice) and age in weeks, frequency and mean turnover per invoice of returning customers.

    Frequency counts invoices; with ``repeat_only`` it counts the repeat purchases, one fewer.
    """
    invoices = lines.groupBy("customer_id", "invoice").agg(
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"), F.sum(line_total()).alias("turnover")
    )
    customers = invoices.groupBy("customer_id").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.count("invoice").alias("invoices"), F.sum("turnover").alias("turnover")
    )
    frequency = F.col("invoices") - 1 if repeat_only else F.col("invoices")
    return customers.filter((F.col("invoices") > 1) & F.col("customer_id").isNotNull()).select(
        "customer_id",
        (whole_days(F.col("last_date"), F.col("first_date")) / 7).alias("recency"),
        (whole_days(today, F.col("first_date")) / 7).alias("age"),
        frequency.alias("frequency"),
        (F.col("turnover") / F.col("invoices")).alias("monetary"),
    )


# --- fitting -------------------------------------------------------------------------------------------------------


def _minimum(
    loss: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 60, h: float = 3e-4, tolerance: float = 5e-7
) -> np.ndarray:
    """Damped Newton search. ``loss`` takes many points at once, so one Spark job serves all differences of a step.

    The differences around the full step are asked for together with the values at shorter steps; when the full step is
    the best, as it mostly is, the next step needs no further job to start from.
    """
    x = start.astype(float)
    size = len(x)
    units = np.eye(size) * h
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size)]
    offsets = [np.zeros(size), *[s * units[i] for i in range(size) for s in (1, -1)]]
    offsets = np.array(offsets + [s * (units[i] + units[j]) for i, j in pairs for s in (1, -1)])
    values = loss(x + offsets)
    for _ in range(steps):
        centre = values[0]
        plus, minus = values[1 : 2 * size + 1 : 2], values[2 : 2 * size + 1 : 2]
        gradient = (plus - minus) / (2 * h)
        hessian = np.diag((plus - 2 * centre + minus) / h**2)
        for k, (i, j) in enumerate(pairs):
            both, neither = values[1 + 2 * size + 2 * k], values[2 + 2 * size + 2 * k]
            mixed = (both + neither - plus[i] - minus[i] - plus[j] - minus[j] + 2 * centre) / (2 * h**2)
            hessian[i, j] = hessian[j, i] = mixed
        curvature, axes = np.linalg.eigh(hessian)
        direction = -axes @ ((axes.T @ gradient) / np.maximum(np.abs(curvature), 1e-4))
        length = np.linalg.norm(direction)
        if length > 2.0:
            direction *= 2.0 / length
        others = x + np.outer(_OTHER_LENGTHS, direction)
        found = loss(np.vstack([x + direction + offsets, others]))
        around, elsewhere = found[: len(offsets)], found[len(offsets) :]
        candidates = np.concatenate([around[:1], elsewhere])
        candidates = np.where(np.isfinite(candidates), candidates, np.inf)
        best = int(np.argmin(candidates))
        gain = centre - candidates[best]
        if not gain > 0:
            return x
        x = x + direction if best == 0 else others[best - 1]
        if gain < tolerance * max(1.0, abs(centre)):
            return x
        values = around if best == 0 else loss(x + offsets)
    raise ArithmeticError(f"the fit did not settle within {steps} steps")


def _summed(table: DataFrame, terms: Callable[[pd.DataFrame, np.ndarray], np.ndarray], points: np.ndarray) -> np.ndarray:
    """Weighted sum of ``terms(rows, point)`` over the table, for every point, in one job."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(points))
        for rows in batches:
            weight = rows["weight"].to_numpy(float)
            for i, point in enumerate(points):
                with np.errstate(all="ignore"):
                    total[i] += float(np.sum(weight * terms(rows, point)))
        yield pd.DataFrame({"point": np.arange(len(points)), "total": total})

    summed = table.mapInPandas(partial, "point int, total double").groupBy("point").agg(F.sum("total").alias("total"))
    result = np.full(len(points), np.nan)
    for row in summed.collect():
        result[row["point"]] = row["total"]
    return result


def _purchase_terms(rows: pd.DataFrame, log_parameters: np.ndarray) -> np.ndarray:
    r, alpha, a, b = np.exp(log_parameters)
    x, tx, age = (rows[c].to_numpy(float) for c in ("frequency", "recency", "age"))
    first = log_gamma(r + x) - log_gamma(np.array(r)) + r * np.log(alpha)
    second = log_gamma(np.array(a + b)) + log_gamma(b + x) - log_gamma(np.array(b)) - log_gamma(a + b + x)
    alive = -(r + x) * np.log(alpha + age)
    dropped = np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + tx)
    dropped = np.where(x > 0, dropped, -np.inf)
    return first + second + np.logaddexp(alive, dropped)


def fit_purchases(features: DataFrame, penalty: float = 0.001) -> PurchaseModel:
    """Maximum likelihood of the BG/NBD model.

    Minimises the mean negative log-likelihood plus ``penalty`` times the sum of squared parameters, with time scaled so
    that the greatest age is 1 (the penalty depends on these two choices).
    """
    table = spread(
        features.groupBy("frequency", "recency", "age").agg(F.count(F.lit(1)).cast("double").alias("weight")), "frequency", "recency", "age"
    )
    limits = features.agg(F.max("age").alias("age"), F.count(F.lit(1)).alias("n")).first()
    scale = 1.0 / limits["age"]
    scaled = reused(table.withColumns({"recency": F.col("recency") * scale, "age": F.col("age") * scale}))

    def loss(points: np.ndarray) -> np.ndarray:
        return -_summed(scaled, _purchase_terms, points) / limits["n"] + penalty * np.sum(np.exp(points) ** 2, axis=1)

    r, alpha, a, b = np.exp(_minimum(loss, np.full(4, 0.1)))
    scaled.unpersist()
    return PurchaseModel(float(r), float(alpha / scale), float(a), float(b))


def _profit_terms(rows: pd.DataFrame, log_parameters: np.ndarray) -> np.ndarray:
    p, q, v = np.exp(log_parameters)
    x, m = (rows[c].to_numpy(float) for c in ("frequency", "monetary"))
    return (
        log_gamma(p * x + q)
        - log_gamma(p * x)
        - log_gamma(np.array(q))
        + q * np.log(v)
        + (p * x - 1) * np.log(m)
        + p * x * np.log(x)
        - (p * x + q) * np.log(x * m + v)
    )


def fit_profit(features: DataFrame, penalty: float = 0.01) -> ProfitModel:
    """Maximum likelihood of the Gamma-Gamma model, mean negative log-likelihood plus the penalty on squared parameters."""
    table = reused(spread(features.select("frequency", "monetary").withColumn("weight", F.lit(1.0))))
    n = table.count()

    def loss(points: np.ndarray) -> np.ndarray:
        return -_summed(table, _profit_terms, points) / n + penalty * np.sum(np.exp(points) ** 2, axis=1)

    p, q, v = np.exp(_minimum(loss, np.full(3, 0.1)))
    table.unpersist()
    return ProfitModel(float(p), float(q), float(v))


# --- prediction ----------------------------------------------------------------------------------------------------


def _expected(model: PurchaseModel, t: float, x: np.ndarray, tx: np.ndarray, age: np.ndarray) -> np.ndarray:
    if t == 0:
        return np.zeros_like(x)
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    z = t / (alpha + age + t)
    # Euler's transformation keeps the series parameters small whatever the frequency.
    series = hypergeometric_2f1(a + b - 1 - r, a - 1, a + b + x - 1, z)
    with np.errstate(over="ignore"):
        growth = (a + b + x - 1) / (a - 1) * (1 - (1 - z) ** (a - 1) * series)
        ratio = np.exp((r + x) * (np.log(alpha + age) - np.log(alpha + tx)))
    return growth / (1 + np.where(x > 0, a / (b + np.maximum(x, 1) - 1) * ratio, 0.0))


def expected_purchases(model: PurchaseModel, t: float, frequency: Column, recency: Column, age: Column) -> Column:
    """Expected number of purchases within the next ``t`` weeks."""

    @F.pandas_udf("double")
    def predict(x: pd.Series, tx: pd.Series, big_t: pd.Series) -> pd.Series:
        return pd.Series(_expected(model, t, x.to_numpy(float), tx.to_numpy(float), big_t.to_numpy(float)))

    return predict(frequency.cast("double"), recency.cast("double"), age.cast("double"))


def discounted_purchases(model: PurchaseModel, months: int, frequency: Column, recency: Column, age: Column, discount: float = 0.01) -> Column:
    """Expected purchases of each coming month, discounted by month, summed."""

    @F.pandas_udf("double")
    def predict(x: pd.Series, tx: pd.Series, big_t: pd.Series) -> pd.Series:
        arrays = [s.to_numpy(float) for s in (x, tx, big_t)]
        total, before = np.zeros(len(x)), np.zeros(len(x))
        for month in range(1, months + 1):
            upto = _expected(model, WEEKS_PER_MONTH * month, *arrays)
            total += (upto - before) / (1 + discount) ** month
            before = upto
        return pd.Series(total)

    return predict(frequency.cast("double"), recency.cast("double"), age.cast("double"))


def expected_profit(model: ProfitModel, frequency: Column, monetary: Column) -> Column:
    """Expected mean profit per purchase given the mean seen so far."""
    p, q, v = (F.lit(value) for value in (model.p, model.q, model.v))
    return F.try_divide(p * (v + frequency * monetary), p * frequency + q - F.lit(1.0))


def with_lifetime_value(features: DataFrame, purchases: PurchaseModel, profit: ProfitModel, months: Sequence[int], discount: float = 0.01) -> DataFrame:
    """Add ``clv_<n>m`` for every horizon."""
    seen = [F.col(c) for c in ("frequency", "recency", "age")]
    margin = expected_profit(profit, F.col("frequency"), F.col("monetary"))
    return features.withColumns({f"clv_{n}m": discounted_purchases(purchases, n, *seen, discount) * margin for n in months})


def scaled_lifetime_value(valued: DataFrame, months: Sequence[int]) -> DataFrame:
    """Add ``scaled_clv_<n>m`` between 0 and 1."""
    return min_max_scaled(valued, {f"clv_{n}m": f"scaled_clv_{n}m" for n in months})


def lifetime_table(lines: DataFrame, today: Column, months: int = 3, purchase_weeks: Sequence[int] = (1, 4, 12)) -> DataFrame:
    """Features, expected purchases, expected profit, lifetime value and its quarter from cleaned lines."""
    features = reused(lifetime_features(lines, today))
    purchases, profit = fit_purchases(features), fit_profit(features)
    seen = [F.col(c) for c in ("frequency", "recency", "age")]
    valued = features.withColumns({f"expected_purchases_{t}w": expected_purchases(purchases, t, *seen) for t in purchase_weeks})
    valued = valued.withColumn("expected_profit", expected_profit(profit, F.col("frequency"), F.col("monetary")))
    valued = reused(with_lifetime_value(valued, purchases, profit, [months]).withColumnRenamed(f"clv_{months}m", "clv"))
    return with_value_segment(valued, "clv", rows=valued.count())


def same_leaders(valued: DataFrame, first: str, second: str, key: str = "customer_id", count: int = 10) -> DataFrame:
    """The best ``count`` keys by two measures side by side, with whether they agree."""
    sides = []
    for name, column in (("first", first), ("second", second)):
        best = valued.orderBy(F.col(column).desc_nulls_last(), key).limit(count)
        order = Window.orderBy(F.col(column).desc_nulls_last(), key)  # over the limited rows only
        sides.append(best.select(F.row_number().over(order).alias("position"), F.col(key).alias(name)))
    both = sides[0].join(sides[1], "position")
    return both.withColumn("same", F.col("first") == F.col("second"))
