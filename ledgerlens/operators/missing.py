"""Missing values: reports and nearest-neighbour imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.profile import null_counts


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: number and percentage with two decimals, most first."""
    counted = null_counts(df).filter(F.col("nulls") > 0)
    ratio = F.bround(F.col("nulls") * F.lit(100.0) / (F.col("nulls") + F.col("present")), 2)
    return counted.select("column", F.col("nulls").alias("n_miss"), ratio.alias("ratio")).orderBy(F.desc("n_miss"), "column")


def missing_columns(df: DataFrame) -> list[str]:
    return [r["column"] for r in missing_report(df).collect()]


def missing_against_target(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Mean and count of the target where each column is missing (flag 1) and where it is present (flag 0)."""
    flags = [F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("int").alias("missing")) for c in columns]
    return (
        df.select(target, F.inline(F.array(*flags)))
        .groupBy("column", "missing")
        .agg(F.avg(target).alias("target_mean"), F.count(target).alias("count"))
    )
