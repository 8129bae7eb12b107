"""Quantile fences and what is done with values beyond them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.order_stats import quantiles
from ledgerlens.session import reused

RETAIL_QUANTILES = (0.01, 0.99)
TABULAR_QUANTILES = (0.005, 0.995)
WIDE_QUANTILES = (0.05, 0.95)

Fences = Mapping[str, tuple[float, float]]


def fences(df: DataFrame, columns: Sequence[str], probabilities: tuple[float, float] = RETAIL_QUANTILES, approx: bool = False) -> dict[str, tuple[float, float]]:
    """Lower and upper limits: the two quantiles, each moved outwards by 1.5 times their distance."""
    found = quantiles(df, {c: probabilities for c in columns}, approx=approx)
    limits = {}
    for c, (low, high) in found.items():
        if low is None:
            limits[c] = (float("-inf"), float("inf"))
        else:
            margin = 1.5 * (high - low)
            limits[c] = (low - margin, high + margin)
    return limits


def beyond(column: str, limits: Fences) -> Column:
    """True where the value lies outside its fences; false for null."""
    low, high = limits[column]
    value = F.col(column)
    return F.coalesce((value < F.lit(low)) | (value > F.lit(high)), F.lit(False))


def clip(df: DataFrame, limits: Fences) -> DataFrame:
    """Move outliers to their fence; the columns become double and nulls stay null."""
    edited = {}
    for c, (low, high) in limits.items():
        value = F.col(c).cast("double")
        edited[c] = F.when(value < F.lit(low), F.lit(low)).when(value > F.lit(high), F.lit(high)).otherwise(value)
    return df.withColumns(edited)


def winsorize(df: DataFrame, columns: Sequence[str], probabilities: tuple[float, float] = RETAIL_QUANTILES) -> DataFrame:
    """Fences from ``df`` itself, then :func:`clip`.

    The fences take several passes. They run over a kept copy of just these columns, so a ``df`` that ends in joins is
    computed twice and not once per pass.
    """
    probe = reused(df.select(*columns))
    limits = fences(probe, columns, probabilities)
    probe.unpersist()
    return clip(df, limits)


def outlier_check(df: DataFrame, columns: Sequence[str], probabilities: tuple[float, float] = TABULAR_QUANTILES) -> DataFrame:
    """One row per column: its fences and whether any value lies beyond."""
    limits = fences(df, columns, probabilities)
    flags = df.agg(*[F.coalesce(F.bool_or(beyond(c, limits)), F.lit(False)).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(limits[c][0]).alias("low"), F.lit(limits[c][1]).alias("high"), F.col(c).alias("has_outliers"))
            for c in columns
        ]
    )
    return flags.select(F.inline(rows))


def outlier_rows(df: DataFrame, column: str, probabilities: tuple[float, float] = TABULAR_QUANTILES) -> DataFrame:
    """All rows with an outlier in ``column``; a head for display is the caller's ``orderBy`` and ``limit``."""
    return df.filter(beyond(column, fences(df, [column], probabilities)))


def outlier_keys(df: DataFrame, column: str, key: str, probabilities: tuple[float, float] = TABULAR_QUANTILES) -> DataFrame:
    """Keys of all outlier rows."""
    return df.filter(beyond(column, fences(df, [column], probabilities))).select(key)


def remove_outliers(df: DataFrame, column: str, probabilities: tuple[float, float] = TABULAR_QUANTILES) -> DataFrame:
    """Rows within the fences; rows with null stay."""
    return df.filter(~beyond(column, fences(df, [column], probabilities)))
