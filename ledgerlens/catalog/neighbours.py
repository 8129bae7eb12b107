"""Nearest neighbours: outlier factors, imputation, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import sql as S
from ledgerlens.catalog.registry import query
from ledgerlens.catalog.segments import today
from ledgerlens.operators import encode, neighbors
from ledgerlens.plans.rfm import clean_lines, rfm_metrics
from ledgerlens.session import reused
from ledgerlens.sources import views
from ledgerlens.sources.tables import parquet_table

MEASURES = ("recency", "frequency", "monetary")


def _standardised(spark, folder):
    metrics = reused(rfm_metrics(clean_lines(views.retail_lines(spark, folder, sold_only=True)), today()).withColumn("monetary", F.round("monetary", 2)))
    return reused(encode.min_max_scaled(metrics, encode.min_max_parameters(metrics, MEASURES)))


_LOF = f"""{S.CLEAN}, {S.rfm('clean').replace('sum(quantity * price) AS', 'round(sum(quantity * price), 2) AS')},
s AS (SELECT customer_id AS id, """ + ", ".join(
    f"({c} - (SELECT min({c}) FROM rfm)) / (SELECT CAST(max({c}) - min({c}) AS DOUBLE) FROM rfm) AS {c[0]}" for c in MEASURES
) + """ FROM rfm),
d AS (SELECT a.id AS p, b.id AS o, sqrt((a.r - b.r) * (a.r - b.r) + (a.f - b.f) * (a.f - b.f) + (a.m - b.m) * (a.m - b.m)) AS d
      FROM s a JOIN s b ON a.id <> b.id),
nn AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, o) AS rk FROM d QUALIFY rk <= 20),
kd AS (SELECT p, max(d) AS kd FROM nn GROUP BY p),
lrd AS (SELECT nn.p, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.p = nn.o GROUP BY nn.p),
lof AS (SELECT nn.p AS customer_id, avg(l.lrd) / any_value(own.lrd) AS lof FROM nn JOIN lrd l ON l.p = nn.o JOIN lrd own ON own.p = nn.p GROUP BY nn.p)"""


@query("O6", f"WITH {_LOF} SELECT customer_id, round(lof, 6) AS lof FROM lof")
def local_outlier_factors(spark, folder):
    found = neighbors.local_outlier_factor(_standardised(spark, folder), MEASURES, "customer_id")
    return found.withColumn("lof", F.round("lof", 6))


@query(
    "O6 J7",
    f"WITH {_LOF} SELECT rfm.customer_id, recency, frequency FROM rfm JOIN lof ON rfm.customer_id = lof.customer_id WHERE lof <= (SELECT lof FROM lof ORDER BY lof DESC LIMIT 1 OFFSET 10)",
)
def local_outliers_removed(spark, folder):
    df = _standardised(spark, folder)
    kept = neighbors.without_local_outliers(df, MEASURES, "customer_id", drop=10)
    metrics = rfm_metrics(clean_lines(views.retail_lines(spark, folder, sold_only=True)), today())
    return metrics.join(kept.select("customer_id"), "customer_id", "left_semi").select("customer_id", "recency", "frequency")


def _gaps(spark, folder):
    """The customer profile with nulls of several patterns."""
    profile = views.profile_table(spark, folder)
    return reused(
        profile.select(
            "id",
            "acctbal",
            F.when(F.col("id") % 11 != 0, F.col("spend")).alias("spend"),
            F.when(F.col("id") % 13 != 0, F.col("n_orders").cast("double")).alias("n_orders"),
            F.col("nationkey").cast("double").alias("nationkey"),
        )
    )


_FEATURES = ("acctbal", "spend", "n_orders", "nationkey")


def _impute_sql() -> str:
    scaled = ", ".join(f"({c} - (SELECT min({c}) FROM g)) / (SELECT max({c}) - min({c}) FROM g) AS {c}" for c in _FEATURES)
    square = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in _FEATURES)
    present = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)" for c in _FEATURES)
    estimates = ", ".join(
        f"""e_{c} AS (SELECT p, avg(v) AS v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY d, o) AS rk FROM
        (SELECT a.id AS p, b.id AS o, sqrt({square}) * sqrt(4.0 / ({present})) AS d, b.{c} AS v FROM s a JOIN s b ON a.{c} IS NULL AND b.{c} IS NOT NULL) QUALIFY rk <= 5) GROUP BY p)"""
        for c in _FEATURES[:3]
    )
    chosen = ", ".join(
        f"round(coalesce(g.{c}, e_{c}.v * (SELECT max({c}) - min({c}) FROM g) + (SELECT min({c}) FROM g)), 3) AS {c}" for c in _FEATURES[:3]
    )
    joins = " ".join(f"LEFT JOIN e_{c} ON e_{c}.p = g.id" for c in _FEATURES[:3])
    return f"""WITH {S.PROFILE}, g AS (SELECT id, acctbal, CASE WHEN id % 11 <> 0 THEN spend END AS spend,
    CASE WHEN id % 13 <> 0 THEN CAST(n_orders AS DOUBLE) END AS n_orders, CAST(nationkey AS DOUBLE) AS nationkey FROM prof),
    s AS (SELECT id, {scaled} FROM g), {estimates} SELECT g.id, {chosen} FROM g {joins}"""


@query("M3 L3", _impute_sql())
def nearest_imputation(spark, folder):
    filled = neighbors.impute_nearest(_gaps(spark, folder), _FEATURES, "id")
    return filled.select("id", *[F.round(c, 3).alias(c) for c in _FEATURES[:3]])


@query(
    "L12",
    """WITH f AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, CAST(regexp_extract(p_brand, '[0-9]+$') AS DOUBLE) AS brand,
      CAST(length(p_name) AS DOUBLE) AS name, p_retailprice AS price FROM part),
    d AS (SELECT a.id AS p, b.id AS o, b.price, sqrt((a.size - b.size) * (a.size - b.size) + (a.brand - b.brand) * (a.brand - b.brand) + (a.name - b.name) * (a.name - b.name)) AS d
          FROM f a JOIN f b ON a.id <> b.id)
    SELECT p AS id, round(avg(price), 4) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, o) AS rk FROM d QUALIFY rk <= 5) GROUP BY p""",
)
def nearest_mean_price(spark, folder):
    part = parquet_table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("double").alias("size"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("double").alias("brand"),
        F.length("p_name").cast("double").alias("name"),
        F.col("p_retailprice").alias("price"),
    )
    part = reused(part)
    found = neighbors.nearest_mean(part, part, ["size", "brand", "name"], "price", "id", exclude_self=True)
    return found.withColumn("prediction", F.round("prediction", 4))
