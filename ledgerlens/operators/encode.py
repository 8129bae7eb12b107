"""Encoding and scaling of feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.order_stats import quantiles, with_position
from ledgerlens.operators.profile import is_text, long_values
from ledgerlens.session import kept, reused, small_side

MAX_LEVELS = 10_000


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted values of categorical columns that become columns of their own: a plan can't hold more than thousands."""
    if not columns:
        return {}
    pairs = long_values(df, columns).filter(F.col("value").isNotNull()).distinct()
    found = pairs.limit(MAX_LEVELS * len(columns) + 1).collect()
    result: dict[str, list[str]] = {c: [] for c in columns}
    for r in found:
        result[r["column"]].append(r["value"])
    if len(found) > MAX_LEVELS * len(columns) or any(len(v) > MAX_LEVELS for v in result.values()):
        raise ValueError("too many levels for a column each; encode rare levels first, or use label codes")
    return {c: sorted(v) for c, v in result.items()}


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, drop_first: bool = True) -> DataFrame:
    """0/1 columns ``column_level`` instead of text columns; the first level is dropped and null is all zeros."""
    chosen = list(columns) if columns is not None else [c for c in df.columns if is_text(df, c)]
    found = levels(df, chosen)
    kept = [F.col(c) for c in df.columns if c not in chosen]
    made = [
        F.coalesce((F.col(c) == level).cast("int"), F.lit(0)).alias(f"{c}_{level}")
        for c in chosen
        for level in found[c][1 if drop_first else 0 :]
    ]
    return df.select(*kept, *made)


def label_encoded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Alphabetical code 0, 1, ... of each level; null stays null. Any number of levels: codes are positions of the
    distinct values, looked up by a join."""
    if not columns:
        return df
    pairs = reused(long_values(df, columns).filter(F.col("value").isNotNull()).distinct())
    coded = with_position(pairs, [("value", False)], "code", ["column"]).withColumn("code", (F.col("code") - 1).cast("int"))
    coded = reused(coded)
    for c in columns:
        own = coded.filter(F.col("column") == c).select(F.col("value").alias(f"_{c}"), F.col("code").alias(f"_code_{c}"))
        df = df.join(small_side(own), F.col(c).cast("string") == F.col(f"_{c}"), "left")
    return df.select(*[F.col(f"_code_{c}").alias(c) if c in columns else F.col(c) for c in df.columns if not c.startswith(tuple(f"_{k}" for k in ("code_", *columns)))])


def rare_encoded(df: DataFrame, share: float, columns: Sequence[str] | None = None, name: str = "Rare") -> DataFrame:
    """Levels of text columns below ``share`` of all rows become one level; nulls stay."""
    chosen = list(columns) if columns is not None else [c for c in df.columns if is_text(df, c)]
    if not chosen:
        return df
    counts = long_values(df, chosen).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    rare_levels = reused(counts.where(F.col("_n") / total < F.lit(share)))
    for c in chosen:
        rare = rare_levels.where(F.col("column") == c).select(F.col("value").alias(f"_{c}"))
        edited = F.when(F.col(f"_{c}").isNotNull(), F.lit(name)).otherwise(F.col(c))
        df = df.join(small_side(rare), F.col(c).cast("string") == F.col(f"_{c}"), "left").withColumn(c, edited).drop(f"_{c}")
    return df


def robust_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minus the median, divided by the distance of the quartiles (by 1 where that is 0)."""
    with kept(df.select(*columns)) as rows:
        found = quantiles(rows, {c: (0.25, 0.5, 0.75) for c in columns})
    edited = {}
    for c, (q1, q2, q3) in found.items():
        if q2 is not None:
            edited[c] = (F.col(c) - F.lit(q2)) / F.lit((q3 - q1) or 1.0)
    return df.withColumns(edited)


def min_max_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None}


def min_max_scaled(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    """0-1 scaling by known limits; a constant column becomes 0."""
    return df.withColumns({c: (F.col(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0) for c, (lo, hi) in parameters.items()})


def min_max_restored(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    """Inverse of :func:`min_max_scaled`."""
    return df.withColumns({c: F.col(c) * F.lit((hi - lo) or 1.0) + F.lit(lo) for c, (lo, hi) in parameters.items()})


def standard_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minus the mean, divided by the population standard deviation (by 1 where that is 0)."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns(
        {c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns) if row[f"m{i}"] is not None}
    )
