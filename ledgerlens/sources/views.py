"""Views over the shared tables with the columns the analyses expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import whole_days
from ledgerlens.sources.tables import parquet_table

TODAY = "2001-08-02 00:00:00"
COURSE_TODAY = "2001-12-01 00:00:00"


LINES_PER_PART = 250_000


def line_parts(spark: SparkSession, folder: str) -> int | None:
    """Partitions for all order lines, counted from the files' footers, where the session's number would make them large."""
    parts = -(-parquet_table(spark, folder, "lineitem").count() // LINES_PER_PART)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def retail_lines(spark: SparkSession, folder: str, sold_only: bool = False) -> DataFrame:
    """Invoice lines: returns carry a ``C`` in front of the invoice number; ``sold_only`` leaves them out in the scan.

    Orders meet customers and nations first, which are one row each, so the lines are shuffled by order and by part alone.
    """
    line, order, part, customer, nation = (
        parquet_table(spark, folder, t) for t in ("lineitem", "orders", "part", "customer", "nation")
    )
    if sold_only:
        line = line.filter(F.col("l_returnflag").isNull() | (F.col("l_returnflag") != "R"))
    parts = line_parts(spark, folder)
    if parts:
        line = line.repartition(parts, "l_orderkey")
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = order.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "o_custkey", "n_name")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice"),
            F.col("l_partkey").cast("string").alias("stock_code"),
            F.col("p_name").alias("description"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
            F.col("o_orderdate").alias("invoice_date"),
            F.col("o_custkey").alias("customer_id"),
            F.col("n_name").alias("country"),
            F.col("p_brand").alias("brand"),
        )
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One rating of 1 to 5 per order line."""
    line, order, part = (parquet_table(spark, folder, t) for t in ("lineitem", "orders", "part"))
    return (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("p_name").alias("title"),
            (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
            F.col("l_shipdate").alias("ts"),
        )
    )


def profile_table(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with order totals, some nulls and a 0/1 target."""
    customer, order = (parquet_table(spark, folder, t) for t in ("customer", "orders"))
    totals = order.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend")
    )
    return customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"),
        F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("mktsegment"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("acctbal"),
        F.col("c_nationkey").cast("long").alias("nationkey"),
        F.col("n_orders"),
        F.col("spend"),
        F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0).cast("long").alias("target"),
    )


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """Up and down votes per user from event types."""
    return (
        parquet_table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.count_if(F.col("event_type").isin("purchase", "signup")).alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))
    )


def star_counts(rated: DataFrame) -> DataFrame:
    """Star counts, number of ratings and mean rating per title."""
    return rated.groupBy("title").agg(
        *[F.count_if(F.col("rating") == k).alias(f"stars_{k}") for k in range(1, 6)],
        F.count(F.lit(1)).alias("n_ratings"),
        F.count_distinct("user_id").alias("n_users"),
        F.avg("rating").alias("rating"),
    )


def course_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings with their age in days and the learner's progress."""
    rated = ratings(spark, folder)
    return rated.select(
        "title",
        "rating",
        whole_days(F.lit(COURSE_TODAY).cast("timestamp"), F.col("ts")).alias("days"),
        (F.col("user_id") % 101).alias("progress"),
    )


def service_table(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as subscribers: three services with Yes / No / No service, and the part type."""
    part = parquet_table(spark, folder, "part")

    def banded(number):
        return F.when(number % 3 == 0, "Yes").when(number % 3 == 1, "No").otherwise("No service")

    brand_number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    return part.select(
        F.col("p_partkey").alias("id"),
        banded(F.col("p_size")).alias("backup"),
        banded(brand_number).alias("support"),
        banded(F.length("p_type")).alias("streaming"),
        F.col("p_type").alias("plan"),
    )


def classified_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with simple features."""
    docs, labels = (parquet_table(spark, folder, t) for t in ("documents", "labels"))
    return docs.select("doc_id", "n_chars", "lang", "source").join(labels, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        "lang",
        "source",
        F.col("toxic").cast("double").alias("toxic"),
        F.col("quality").cast("double").alias("label"),
    )


def priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the net price as the regression target."""
    return parquet_table(spark, folder, "lineitem").select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").alias("id"),
        F.col("l_extendedprice").alias("extended"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("label"),
    )


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a 0-1 score (value over its maximum) and a binary label."""
    events = parquet_table(spark, folder, "events")
    top = events.agg(F.max("value")).scalar()
    return events.select(
        "event_id",
        F.try_divide(F.col("value"), top).alias("score"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
    )
