"""Row and column clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import PICK_FACTOR, contains_mark, key_spot, zero_as_null


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any null (or NaN) in the given columns, by default in all.

    One condition for each column, so that each can be pushed below joins to the scan its column comes from.
    """
    for c in columns or df.columns:
        value = F.col(f"`{c}`")
        df = df.filter(value.isNotNull())
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            df = df.filter(~F.isnan(value))
    return df


def drop_cancelled(df: DataFrame, invoice: str = "invoice", mark: str = "C") -> DataFrame:
    """Without rows whose invoice carries the cancellation mark anywhere."""
    return df.filter(~contains_mark(F.col(invoice), mark))


def positive_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    condition = F.lit(True)
    for c in columns:
        condition = condition & (F.col(c) > 0)
    return df.filter(condition)


def drop_matching(df: DataFrame, *conditions) -> DataFrame:
    """Without the rows that meet any condition; rows where a condition is unknown stay."""
    for condition in conditions:
        df = df.filter(~F.coalesce(condition, F.lit(False)))
    return df


def zeros_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: zero_as_null(F.col(c)) for c in columns})


def zero_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: whether it holds a zero and how many values are null after zeros are taken as missing."""
    counted = df.agg(
        *[F.count_if(F.col(c) == 0).alias(f"z_{c}") for c in columns],
        *[F.count_if(zero_as_null(F.col(c)).isNull()).alias(f"n_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), (F.col(f"z_{c}") > 0).alias("has_zero"), F.col(f"n_{c}").alias("converted"))
            for c in columns
        ]
    )
    return counted.select(F.inline(rows))


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` for every key. An aggregate with map-side combine, so a common key is cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """First ``value`` of every key in ``order``."""
    return df.groupBy(key).agg(F.min_by(F.col(value), F.struct(*order)).alias(value))


def distinct_columns(columns: Sequence[str]) -> list[str]:
    """Column names without repeats, first occurrence kept."""
    return list(dict.fromkeys(columns))


def pick_one(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One repeatable pseudo-random whole-number key: the one whose seeded number is smallest. A plain aggregate."""
    return df.agg(F.min_by(key, F.struct(key_spot(F.col(key), seed, PICK_FACTOR), F.col(key))).alias(key))


def titles_containing(df: DataFrame, title: str, keyword: str) -> DataFrame:
    return df.select(title).distinct().filter(F.col(title).contains(keyword))
