"""Content-based recommendations: cosine of TF-IDF weights, found through the terms of the seed text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.recommend import TIE_DECIMALS
from ledgerlens.session import materialized, reused, small_side

TOKEN = r"[\p{L}\p{N}_]{2,}"


# The default stop words, common English function words.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both
    but by can could did do does doing down during each few for from further had has have having he her here hers herself
    him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
    other our ours ourselves out over own same she should so some such than that the their theirs them themselves then
    there these they this those through to too under until up very was we were what when where which while who whom why
    will with would you your yours yourself yourselves""".split()
)


def term_counts(df: DataFrame, key: str, text: str, stop_words: Sequence[str]) -> DataFrame:
    """``(key, term, tf)``. The tokens of one text are combined where they arise, before any shuffle."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    exploded = df.select(key, F.explode(tokens).alias("term"))
    if stop_words:
        exploded = exploded.filter(~F.col("term").isin(list(stop_words)))
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequency(counts: DataFrame, documents: int) -> DataFrame:
    """``(term, idf)`` with ``idf = ln((1 + n) / (1 + df)) + 1``."""
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return frequency.select("term", (F.log(F.lit(1.0 + documents) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def term_weights(df: DataFrame, key: str, text: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(key, term, weight)``: term count times inverse document frequency, not yet normalised."""
    counts = reused(term_counts(df, key, text, STOP_WORDS if stop_words is None else stop_words))
    idf = small_side(inverse_frequency(counts, df.count()))
    return counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def similar_texts(df: DataFrame, key: str, text: str, seed, count: int | None = 10, stop_words: Sequence[str] | None = None) -> DataFrame:
    """The ``count`` texts nearest to the seed text (itself left out), or all that share a term with it.

    Dot products and norms come from one pass over the weights; only terms of the seed contribute to the products, and
    each (text, term) pair meets at most one seed weight. The weights of the one seed text are written out first, so
    their size is known when they are joined.
    """
    weights = term_weights(df, key, text, stop_words)
    wanted = materialized(weights.filter(F.col(key) == seed).select("term", F.col("weight").alias("seed_weight")), "seed-text")
    seed_norm = wanted.agg(F.sqrt(F.sum(F.col("seed_weight") * F.col("seed_weight"))).alias("norm")).first()["norm"]
    measured = weights.join(wanted, "term", "left").groupBy(key).agg(
        F.sum(F.col("weight") * F.col("seed_weight")).alias("dot"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
    )
    scored = measured.filter((F.col(key) != seed) & F.col("dot").isNotNull()).select(
        key, F.try_divide(F.col("dot"), F.col("norm") * F.lit(seed_norm).cast("double")).alias("score")
    )
    return scored if count is None else scored.orderBy(F.round("score", TIE_DECIMALS).desc(), key).limit(count)
