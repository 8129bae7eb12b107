"""Recency, frequency, monetary: metrics, scores and segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import replaced_patterns, whole_days
from ledgerlens.operators.binning import bin_by_edges, first_rank_bins, label_bins, quantile_edges
from ledgerlens.operators.clean import drop_cancelled, drop_null_rows, positive_rows
from ledgerlens.operators.order_stats import with_running_sum
from ledgerlens.operators.outliers import RETAIL_QUANTILES, winsorize
from ledgerlens.session import reused

# Recency digit and frequency digit to segment name.
SEGMENTS = {
    "[1-2][1-2]": "hibernating",
    "[1-2][3-4]": "at_risk",
    "[1-2]5": "cant_loose",
    "3[1-2]": "about_to_sleep",
    "33": "need_attention",
    "[3-4][4-5]": "loyal_customers",
    "41": "promising",
    "51": "new_customers",
    "[4-5][2-3]": "potential_loyalists",
    "5[4-5]": "champions",
}

# The two names that differ in the other wording of the segments.
SHORT_NAMES = {"at_risk": "at_Risk", "new_customers": "new"}


def segment_names(short: bool = False) -> dict[str, str]:
    """Digit patterns to segment names, in either wording."""
    return {p: SHORT_NAMES.get(n, n) if short else n for p, n in SEGMENTS.items()}


def clean_lines(lines: DataFrame, clip_outliers: bool = False, probabilities: tuple[float, float] = RETAIL_QUANTILES) -> DataFrame:
    """Complete, not cancelled lines with positive quantity and price; optionally with both clipped to their fences."""
    kept = positive_rows(drop_cancelled(drop_null_rows(lines)), ["quantity", "price"])
    return winsorize(kept, ["price", "quantity"], probabilities) if clip_outliers else kept


def line_total() -> Column:
    return F.col("quantity") * F.col("price")


def rfm_metrics(lines: DataFrame, today: Column) -> DataFrame:
    """Days since the last invoice, number of invoices and turnover per customer with positive turnover.

    Lines are first summed per invoice, so the second shuffle carries one row per invoice and a customer or invoice
    with very many lines is reduced before any of them meet.
    """
    invoices = lines.groupBy("customer_id", "invoice").agg(
        F.max("invoice_date").alias("last_date"), F.sum(line_total()).alias("turnover")
    )
    return (
        invoices.groupBy("customer_id")
        .agg(F.max("last_date").alias("last_date"), F.count("invoice").alias("frequency"), F.sum("turnover").alias("monetary"))
        .filter((F.col("monetary") > 0) & F.col("customer_id").isNotNull())
        .select("customer_id", whole_days(today, F.col("last_date")).alias("recency"), "frequency", "monetary")
    )


def rfm_scores(metrics: DataFrame) -> DataFrame:
    """Scores 1 to 5 and the two-digit code. ``metrics`` is read several times: persist it first."""
    rows = metrics.count()
    edges = quantile_edges(metrics, ["recency", "monetary"], 5, rows=rows)
    frequency = first_rank_bins(metrics, "frequency", "customer_id", 5, rows)
    scored = metrics.withColumns(
        {
            "recency_score": label_bins(bin_by_edges(F.col("recency"), edges["recency"]), [5, 4, 3, 2, 1]),
            "frequency_score": frequency,
            "monetary_score": bin_by_edges(F.col("monetary"), edges["monetary"]),
        }
    )
    code = F.concat(F.col("recency_score").cast("string"), F.col("frequency_score").cast("string"))
    return scored.withColumn("rfm_score", code)


def with_segment(scored: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    return scored.withColumn("segment", replaced_patterns(F.col("rfm_score"), names or segment_names()))


def rfm_segments(lines: DataFrame, today: Column, clip_outliers: bool = True, names: Mapping[str, str] | None = None) -> DataFrame:
    """Segments of all customers straight from raw invoice lines."""
    metrics = reused(rfm_metrics(clean_lines(lines, clip_outliers), today))
    return with_segment(rfm_scores(metrics), names)


def segment_members(segmented: DataFrame, segment: str) -> DataFrame:
    return segmented.filter(F.col("segment") == segment)


def segment_sizes(segmented: DataFrame, segment: str = "segment", key: str = "customer_id") -> DataFrame:
    return segmented.groupBy(segment).agg(F.count_distinct(key).alias("customers"))


def described(df: DataFrame, columns: Sequence[str], by: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, minimum, quantiles and maximum of each column per group, one row per pair.

    Quantiles come from counts of distinct values added up in order within each group, so any number of groups is
    described in the plan, and a large group is spread over ranges. ``df`` is read several times.
    """
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(F.col(by).alias("_by"), values)
    basic = long.groupBy("_by", "column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    counted = reused(long.filter(F.col("value").isNotNull()).groupBy("_by", "column", "value").agg(F.count(F.lit(1)).alias("_c")))
    summed = with_running_sum(counted, [("value", False)], {"_c": "_upto"}, ["_by", "column"])
    totals = basic.select(F.col("_by").alias("_g"), F.col("column").alias("_column"), (F.col("n") - 1).alias("_last"))
    placed = summed.join(totals, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("column") == F.col("_column")))
    figures = []
    for p in probabilities:
        at = F.col("_last") * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        here = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("value")))
        share = F.max(at - low)
        figures.append((here(low) * (1 - share) + here(high) * share).alias(f"p{round(p * 100)}"))
    found = placed.groupBy("_g", "_column").agg(*figures)
    joined = basic.join(found, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("column") == F.col("_column")), "left")
    names = [f"p{round(p * 100)}" for p in probabilities]
    return joined.select(F.col("_by").alias(by), "column", "n", "mean", "std", "min", "max", *names)
