"""Quantile, equal-width and fixed-edge bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.order_stats import ROWS_PER_TASK, quantiles, with_position


class DuplicateEdges(ValueError):
    """Two quantile edges coincide, so the bins asked for do not exist."""


def quantile_edges(
    df: DataFrame, columns: Sequence[str], bins: int, duplicates: str = "raise", rows: int | None = None
) -> dict[str, list[float]]:
    """Bin edges (lowest to highest) of several columns in one go; ``rows`` is the row count if known."""
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles(df, {c: probs for c in columns}, rows)
    for c, values in edges.items():
        if any(v is None for v in values):
            raise ValueError(f"column {c} has no values to bin")
        unique = sorted(set(values))
        if len(unique) < len(values):
            if duplicates != "drop":
                raise DuplicateEdges(f"bin edges of {c} are not unique: {values}")
            edges[c] = unique
    return edges


def bin_by_edges(value: Column, edges: Sequence[float]) -> Column:
    """1-based bin of right-closed intervals whose lowest edge is included; null outside the edges or for null."""
    bins = F.when(value < F.lit(edges[0]), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:], start=1):
        bins = bins.when(value <= F.lit(upper), F.lit(i))
    return bins


def label_bins(bins: Column, labels: Sequence) -> Column:
    """Replace the bin number 1..n by the matching label."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), bins)


def quantile_bins(df: DataFrame, value: str, bins: int, labels: Sequence | None = None, name: str | None = None, duplicates: str = "raise") -> DataFrame:
    """Add equally populated bins of ``value``; give a persisted frame, it is read more than once."""
    edges = quantile_edges(df, [value], bins, duplicates)[value]
    number = bin_by_edges(F.col(value), edges)
    return df.withColumn(name or f"{value}_bin", label_bins(number, labels) if labels else number)


def first_rank_bins(
    df: DataFrame, value: str, key: str, bins: int, rows: int | None = None, rows_per_task: int = ROWS_PER_TASK
) -> Column:
    """Bins of the rank of ``value`` with ties broken by ``key`` ascending (key unique); null values rank last.

    Up to ``rows_per_task`` rows are ranked by a window. Beyond, the last row of every bin is found as a pair
    (value, key), in the columns' own types; comparing with those few pairs needs neither a sort nor a shuffle of the rows,
    and stays even when one value is carried by most of them.
    """
    n = df.count() if rows is None else rows
    if n <= 1:
        return F.lit(1)
    if n <= rows_per_task:
        rank = F.row_number().over(Window.orderBy(F.col(value).asc_nulls_last(), F.col(key).asc_nulls_last())).cast("long")
        return F.greatest(F.lit(1), F.ceil((rank - 1) * F.lit(bins) / F.lit(n - 1))).cast("int")
    last_rank = [1 + ((n - 1) * k) // bins for k in range(1, bins)]  # 1-based rank of the last row in bin k
    pairs = df.select(F.col(value).alias("_v"), F.col(key).alias("_k"))
    placed = with_position(pairs, [("_v", False), ("_k", False)], "_position", rows_per_task=rows_per_task)
    ends = {r["_position"]: r for r in placed.filter(F.col("_position").isin(last_rank)).collect()}
    result = None
    for k, rank in enumerate(last_rank, start=1):
        v, last_key = F.lit(ends[rank]["_v"]).cast(df.schema[value].dataType), F.lit(ends[rank]["_k"]).cast(df.schema[key].dataType)
        if ends[rank]["_v"] is None:
            upto = F.col(value).isNotNull() | (F.col(key) <= last_key)
        else:
            upto = (F.col(value) < v) | ((F.col(value) == v) & (F.col(key) <= last_key))
        result = F.when(upto, F.lit(k)) if result is None else result.when(upto, F.lit(k))
    return result.otherwise(F.lit(bins))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin of ``bins`` equal intervals between ``low`` and ``high``, right-closed, the minimum in bin 1.

    When all values are equal, the range is widened evenly and every row falls into the middle bin.
    """
    spread = F.greatest(F.lit(1), F.ceil((value - low) * F.lit(bins) / F.nullif(high - low, F.lit(0))))
    middle = F.lit(math.ceil(bins / 2))
    return F.when(value.isNull(), None).when(high == low, middle).otherwise(F.least(F.lit(bins), spread)).cast("int")


def fixed_bins(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest edge excluded; null outside."""
    result = F.when(value <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        result = result.when(value <= F.lit(upper), F.lit(label))
    return result


def age_band(age: Column, bands: Sequence[tuple[int, int]]) -> Column:
    """``low_high`` label of the closed whole-number band that holds ``age``."""
    result = None
    for low, high in bands:
        label = F.lit(f"{low}_{high}")
        result = F.when(age.between(low, high), label) if result is None else result.when(age.between(low, high), label)
    return result
