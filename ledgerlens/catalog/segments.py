"""Cleaning, recency-frequency-monetary segments and calculated lifetime value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import sql as S
from ledgerlens.catalog.registry import query, single
from ledgerlens.operators.order_stats import with_position
from ledgerlens.plans import cltv, rfm
from ledgerlens.session import reused
from ledgerlens.sources import views


def today():
    return F.lit(views.TODAY).cast("timestamp")


def segmented(spark, folder):
    return rfm.rfm_segments(views.retail_lines(spark, folder, sold_only=True), today())


@query(
    "P1 P2 P3 P7 F1",
    f"""WITH {S.CLEAN}
    SELECT country, count(*) AS n_lines, count(DISTINCT invoice) AS n_invoices, CAST(sum(quantity) AS BIGINT) AS units
    FROM clean GROUP BY country""",
)
def retail_clean_by_country(spark, folder):
    lines = rfm.clean_lines(views.retail_lines(spark, folder, sold_only=True))
    return lines.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("invoice").alias("n_invoices"), F.sum("quantity").alias("units")
    )


@query(
    "C14 O1 O2 P8",
    f"""WITH {S.CLIPPED}
    SELECT brand, count(*) AS n_lines, round(max(price), 4) AS top_price, round(max(quantity), 4) AS top_quantity,
           round(sum(quantity * price), 2) AS turnover FROM clipped GROUP BY brand""",
)
def retail_prepared_by_brand(spark, folder):
    lines = rfm.clean_lines(views.retail_lines(spark, folder, sold_only=True), clip_outliers=True)
    return lines.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.max("price"), 4).alias("top_price"),
        F.round(F.max("quantity"), 4).alias("top_quantity"),
        F.round(F.sum(rfm.line_total()), 2).alias("turnover"),
    )


@query(
    "A1 T1 T2",
    f"""WITH {S.RETAIL} SELECT description, CAST(sum(quantity) AS BIGINT) AS units FROM retail
    GROUP BY description ORDER BY units DESC, description LIMIT 10""",
)
def top_products_by_quantity(spark, folder):
    return (
        views.retail_lines(spark, folder)
        .groupBy("description")
        .agg(F.sum("quantity").alias("units"))
        .orderBy(F.desc("units"), "description")
        .limit(10)
    )


@query(
    "C1 A1 A2 F6 U1",
    f"""WITH {S.CLIPPED}, {S.rfm()} SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary FROM rfm""",
)
def rfm_metrics(spark, folder):
    lines = rfm.clean_lines(views.retail_lines(spark, folder, sold_only=True), clip_outliers=True)
    return rfm.rfm_metrics(lines, today()).withColumn("monetary", F.round("monetary", 2))


@query(
    "C2 C3 W1 W2 F2 F3 F9",
    f"""WITH {S.CLIPPED}, {S.SCORES}
    SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary, recency_score, frequency_score,
           monetary_score, rfm_score, segment FROM segmented""",
)
def rfm_segments(spark, folder):
    return segmented(spark, folder).withColumn("monetary", F.round("monetary", 2))


@query(
    "C3 W2",
    f"""WITH {S.CLEAN}, {S.SCORES.replace('FROM clipped', 'FROM clean')}
    SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary, segment FROM segmented""",
)
def rfm_segments_unclipped(spark, folder):
    found = rfm.rfm_segments(views.retail_lines(spark, folder, sold_only=True), today(), clip_outliers=False)
    return found.select("customer_id", "recency", "frequency", F.round("monetary", 2).alias("monetary"), "segment")


@query("C4 E13", f"WITH {S.CLIPPED}, {S.SCORES} SELECT segment, count(DISTINCT customer_id) AS customers FROM segmented GROUP BY segment")
def rfm_segment_sizes(spark, folder):
    return rfm.segment_sizes(segmented(spark, folder))


def _profile_arm(column: str) -> str:
    figures = {
        "mean": f"avg({column})",
        "std": f"stddev_samp({column})",
        "min": f"min({column})",
        "p25": f"quantile_cont({column}, 0.25)",
        "p50": f"quantile_cont({column}, 0.5)",
        "p75": f"quantile_cont({column}, 0.75)",
        "max": f"max({column})",
    }
    listed = ", ".join(f"{S.single(e)} AS {n}" for n, e in figures.items())
    return f"""SELECT segment, '{column}' AS "column", count({column}) AS n, {listed} FROM segmented GROUP BY segment"""


@query(
    "C4 A6",
    f"WITH {S.CLIPPED}, {S.SCORES} " + " UNION ALL ".join(_profile_arm(c) for c in ("recency", "frequency", "monetary")),
)
def rfm_segment_profile(spark, folder):
    found = reused(segmented(spark, folder))
    rows = rfm.described(found, ["recency", "frequency", "monetary"], "segment")
    return rows.select(
        "segment", "column", "n", *[single(F.col(c)).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


@query(
    "C4 P4",
    f"""WITH {S.CLIPPED}, {S.SCORES}
    SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary FROM segmented WHERE segment = 'loyal_customers'""",
)
def loyal_customers(spark, folder):
    members = rfm.segment_members(segmented(spark, folder), "loyal_customers")
    return members.select("customer_id", "recency", "frequency", F.round("monetary", 2).alias("monetary"))


@query(
    "W1",
    f"""WITH {S.CLEAN}, {S.rfm('clean')}
    SELECT customer_id, frequency, row_number() OVER (ORDER BY frequency, customer_id) AS frequency_rank FROM rfm""",
)
def frequency_first_rank(spark, folder):
    metrics = reused(rfm.rfm_metrics(rfm.clean_lines(views.retail_lines(spark, folder, sold_only=True)), today()).select("customer_id", "frequency"))
    return with_position(metrics, [("frequency", False), ("customer_id", False)], "frequency_rank")


@query(
    "C5 J2 A1 U1 L3",
    f"""WITH {S.CLEAN},
    base AS (SELECT customer_id, count(DISTINCT invoice) AS total_transaction, CAST(sum(quantity) AS BIGINT) AS total_unit,
                    sum(quantity * price) AS total_price FROM clean GROUP BY customer_id),
    totals AS (SELECT count(*) AS n, 1 - count(*) FILTER (total_transaction > 1) / count(*) AS churn FROM base),
    valued AS (SELECT base.*, total_price / total_transaction AS avg_order_value, total_transaction / n AS purchase_frequency,
                      total_price * 0.1 AS profit_margin, total_price / total_transaction * (total_transaction / n) AS customer_value,
                      total_price / total_transaction * (total_transaction / n) / churn * (total_price * 0.1) AS cltv
               FROM base, totals),
    scaled AS (SELECT *, (cltv - (SELECT min(cltv) FROM valued)) / (SELECT max(cltv) - min(cltv) FROM valued) AS scaled_cltv FROM valued)
    SELECT customer_id, total_transaction, total_unit, {S.single("total_price")} AS total_price,
           {S.single("avg_order_value")} AS avg_order_value, {S.single("purchase_frequency")} AS purchase_frequency,
           {S.single("profit_margin")} AS profit_margin, {S.single("customer_value")} AS customer_value,
           {S.single("scaled_cltv")} AS scaled_cltv,
           substr('DCBA', {S.quantile_bin('scaled_cltv', 'scaled', 4)}, 1) AS segment FROM scaled""",
)
def calculated_lifetime_value(spark, folder):
    found = cltv.calculated_value(views.retail_lines(spark, folder, sold_only=True))
    return found.select(
        "customer_id",
        "total_transaction",
        "total_unit",
        single(F.col("total_price")).alias("total_price"),
        single(F.col("avg_order_value")).alias("avg_order_value"),
        single(F.col("purchase_frequency")).alias("purchase_frequency"),
        single(F.col("profit_margin")).alias("profit_margin"),
        single(F.col("customer_value")).alias("customer_value"),
        single(F.col("scaled_cltv")).alias("scaled_cltv"),
        "segment",
    )
