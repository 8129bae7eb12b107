"""Frequent item sets, association rules and recommendations from them."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import reused

MASK_BITS = 12
FLAG_BITS = 62


def basket_items(lines: DataFrame, item: str, country: str | None = None, excluded: str | None = "POST", code: str = "stock_code", parts: int | None = None) -> DataFrame:
    """Distinct (invoice, item) pairs with positive total quantity, of one country if given, without the postage code.

    With ``parts`` the lines are dealt to so many partitions by invoice, where pairs, and what is made of an invoice's pairs
    after that, need no further shuffle.
    """
    if country is not None:
        lines = lines.filter(F.col("country") == country)
    if excluded is not None:
        lines = lines.filter(F.coalesce(F.col(code) != excluded, F.lit(True)))
    named = lines.filter(F.col("invoice").isNotNull() & F.col(item).isNotNull()).select("invoice", F.col(item).alias("item"), "quantity")
    return (
        (named.repartition(parts, "invoice") if parts else named)
        .groupBy("invoice", "item")
        .agg(F.sum("quantity").alias("quantity"))
        .filter(F.col("quantity") > 0)
        .select("invoice", "item")
    )


def basket_flags(pairs: DataFrame, items: list[str]) -> DataFrame:
    """Invoice by item table of 0/1 for the listed items (a wide view for inspection).

    Flags are gathered as bits of a few whole numbers, so that what is aggregated and shuffled for an invoice stays narrow.
    """
    listed = list(dict.fromkeys(items))
    words = [listed[at : at + FLAG_BITS] for at in range(0, len(listed), FLAG_BITS)]

    def bits(word: list[str]) -> Column:
        bit = F.create_map(*[c for n, i in enumerate(word) for c in (F.lit(i), F.lit(1 << n).cast("long"))])
        return F.when(F.col("item").isNotNull(), F.coalesce(F.try_element_at(bit, F.col("item")), F.lit(0).cast("long")))

    gathered = pairs.groupBy("invoice").agg(*[F.bit_or(bits(w)).alias(f"_flags{k}") for k, w in enumerate(words)])
    place = {i: (k, n) for k, w in enumerate(words) for n, i in enumerate(w)}
    return gathered.select("invoice", *[F.expr(f"CAST(shiftright(_flags{k}, {n}) & 1 AS INT)").alias(i) for i in items for k, n in [place[i]]])


def frequent_sets(pairs: DataFrame, min_support: float = 0.01) -> DataFrame:
    """Item sets in at least ``min_support`` of all invoices: ``(items, count, support)``, items sorted.

    Rare items cannot be in a frequent set, so they are dropped before baskets are gathered: what is gathered per
    invoice is bounded by the number of frequent items.
    """
    pairs = reused(pairs)
    invoices = pairs.agg(F.count_distinct("invoice").alias("n")).first()["n"]
    threshold = max(1, math.ceil(min_support * invoices - 1e-9))
    common = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= threshold).select("item")
    baskets = reused(pairs.join(common, "item").groupBy("invoice").agg(F.collect_set("item").alias("items")).select("items"))
    kept = baskets.count()
    if kept == 0:
        return pairs.sparkSession.createDataFrame([], "items array<string>, count long, support double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (threshold - 0.5) / kept))).fit(baskets)
    return model.freqItemsets.select(
        F.sort_array("items").alias("items"), F.col("freq").alias("count"), (F.col("freq") / F.lit(float(invoices))).alias("support")
    )


def association_rules(sets: DataFrame, min_support: float = 0.01) -> DataFrame:
    """Every split of every frequent set into two non-empty parts, with the usual measures.

    All subsets of a frequent set are frequent, so both parts find their support in ``sets``.
    """
    sets = reused(sets.filter(F.col("support") >= min_support))
    longest = sets.agg(F.max(F.size("items")).alias("k")).first()["k"] or 0
    split = sets.filter(F.size("items") >= 2).select("items", "support", F.lit(0).cast("long").alias("mask"))
    for low in range(0, longest, MASK_BITS):  # a few bits at a time, so that no row holds all splits of a long set
        some = F.expr(f"sequence(0L, shiftleft(1L, least(greatest(size(items) - {low}, 0), {MASK_BITS})) - 1)")
        split = split.select("items", "support", "mask", F.explode(some).alias("bits"))
        split = split.select("items", "support", (F.col("mask") + F.shiftleft("bits", low)).alias("mask"))
    split = split.filter("mask > 0 AND mask < shiftleft(1L, size(items)) - 1")

    def chosen(bit: int) -> Column:
        return F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {bit})")

    split = split.select(chosen(1).alias("antecedents"), chosen(0).alias("consequents"), "support")
    left = sets.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    right = sets.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    joined = split.join(left, "antecedents").join(right, "consequents")
    confidence = F.col("support") / F.col("antecedent_support")
    conviction = F.when(confidence >= 1, F.lit(float("inf"))).otherwise(
        F.try_divide(F.lit(1.0) - F.col("consequent_support"), F.lit(1.0) - confidence)
    )
    return joined.select(
        "antecedents",
        "consequents",
        "antecedent_support",
        "consequent_support",
        "support",
        confidence.alias("confidence"),
        (confidence / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        conviction.alias("conviction"),
    )


def recommended_items(rules: DataFrame, score: str = "support", first_only: bool = True, count: int | None = None) -> DataFrame:
    """For every item: items that rules with it on the left suggest, best score first, ties by item.

    ``first_only`` takes just the first item of each right side. The result holds ``(item, recommended, score, position)``.
    """
    right = F.slice("consequents", 1, 1) if first_only else F.col("consequents")
    pairs = rules.select(F.explode("antecedents").alias("item"), right.alias("right"), F.col(score).alias("score"))
    best = (
        pairs.select("item", F.explode("right").alias("recommended"), "score")
        .groupBy("item", "recommended")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("item").orderBy(F.round("score", 10).desc(), F.col("recommended"))
    ranked = best.withColumn("position", F.row_number().over(order))
    return ranked if count is None else ranked.filter(F.col("position") <= count)


def with_description(recommendations: DataFrame, descriptions: DataFrame, code: str, text: str) -> DataFrame:
    """Add the description of each recommended item."""
    names = descriptions.select(F.col(code).alias("recommended"), F.col(text).alias("description"))
    return recommendations.join(names, "recommended", "left")
