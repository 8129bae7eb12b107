"""Lifetime value calculated from averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.binning import bin_by_edges, label_bins, quantile_edges
from ledgerlens.plans.rfm import clean_lines, line_total
from ledgerlens.session import reused

VALUE_LABELS = ("D", "C", "B", "A")


def min_max_scaled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add 0-1 scaled copies ``{column: new name}``; a constant column scales to 0."""
    limits = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    added = {}
    for c, new in columns.items():
        low, high = limits[f"lo_{c}"], limits[f"hi_{c}"]
        if low is None:
            added[new] = F.lit(None).cast("double")
        else:
            spread = float(high) - float(low)
            added[new] = (F.col(c) - F.lit(low)) / F.lit(spread if spread else 1.0)
    return df.withColumns(added)


def with_value_segment(df: DataFrame, value: str, name: str = "segment", rows: int | None = None) -> DataFrame:
    """Quarter of ``value``, A the best."""
    edges = quantile_edges(df, [value], 4, rows=rows)[value]
    return df.withColumn(name, label_bins(bin_by_edges(F.col(value), edges), VALUE_LABELS))


def calculated_value(lines: DataFrame, profit: float = 0.10) -> DataFrame:
    """Average order value, purchase frequency, margin, value, scaled value and quarter per customer.

    Repeat and churn rate are shares of all customers. Without any churn the value is undefined (null), as are the
    scaled value and the segment.
    """
    invoices = clean_lines(lines).groupBy("customer_id", "invoice").agg(
        F.sum("quantity").alias("units"), F.sum(line_total()).alias("turnover")
    )
    customers = reused(
        invoices.groupBy("customer_id").agg(
            F.count("invoice").alias("total_transaction"), F.sum("units").alias("total_unit"), F.sum("turnover").alias("total_price")
        )
    )
    totals = customers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total_transaction") > 1).alias("repeaters")).first()
    n = totals["n"]
    churn = 1 - totals["repeaters"] / n if n else None
    order_value = F.col("total_price") / F.col("total_transaction")
    purchase_frequency = F.col("total_transaction") / F.lit(float(n or 1))
    valued = customers.select(
        "*",
        order_value.alias("avg_order_value"),
        purchase_frequency.alias("purchase_frequency"),
        (F.col("total_price") * F.lit(profit)).alias("profit_margin"),
        (order_value * purchase_frequency).alias("customer_value"),
    )
    valued = valued.withColumn(
        "cltv", F.try_divide(F.col("customer_value"), F.lit(churn).cast("double")) * F.col("profit_margin")
    )
    if not churn:
        return valued.withColumns({"scaled_cltv": F.lit(None).cast("double"), "segment": F.lit(None).cast("string")})
    return with_value_segment(min_max_scaled(valued, {"cltv": "scaled_cltv"}), "scaled_cltv", rows=n)
