"""User-based, item-based and hybrid recommendations from ratings in long form ``(user_id, title, rating, ts)``.

The user by title matrix stays in long form throughout. A target user's titles are at most the number of titles, a seed
title has at most one mean rating per user, so every join below adds columns and never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerlens.operators.binning import equal_width_bin
from ledgerlens.operators.profile import pearson
from ledgerlens.session import reused, small_side

TIE_DECIMALS = 10


def popular_titles(ratings: DataFrame, more_than: int = 1000) -> DataFrame:
    """Titles with more than so many ratings."""
    return ratings.groupBy("title").agg(F.count("rating").alias("n")).filter(F.col("n") > more_than).select("title")


def user_titles(ratings: DataFrame, more_than: int = 1000) -> DataFrame:
    """Mean rating per user and popular title."""
    means = ratings.filter(F.col("user_id").isNotNull()).groupBy("user_id", "title").agg(
        F.avg("rating").alias("rating"), F.count("rating").alias("n")
    )
    return means.join(small_side(popular_titles(ratings, more_than)), "title").filter(F.col("rating").isNotNull()).select("user_id", "title", "rating")


def _target(titles: DataFrame, user: int) -> DataFrame:
    return titles.filter(F.col("user_id") == user).select("title", F.col("rating").alias("own"))


def shared_counts(titles: DataFrame, user: int) -> DataFrame:
    """Number of the target user's titles each user has rated, the target included."""
    return titles.join(small_side(_target(titles, user).select("title")), "title").groupBy("user_id").agg(F.count("rating").alias("shared"))


def sharing_bin(counts: DataFrame, bins: int = 100) -> Column:
    """Bin of ``shared`` among equal intervals over the observed counts."""
    seen = counts.agg(F.min("shared").alias("low"), F.max("shared").alias("high")).first()
    if seen["low"] is None:
        return F.lit(None).cast("int")
    return equal_width_bin(F.col("shared"), F.lit(seen["low"]), F.lit(seen["high"]), bins)


def neighbours(
    titles: DataFrame,
    user: int,
    min_corr: float,
    min_bin: int | None = None,
    above_bin: int | None = None,
    more_than: int | None = None,
) -> DataFrame:
    """Users that share many titles with the target and rate them alike: ``(user_id, shared, corr)``.

    Enough sharing means a bin (of 100 over the observed counts) of at least ``min_bin`` or above ``above_bin``, or
    more than ``more_than`` titles. Counts and correlations come from one aggregate.
    """
    both = titles.join(small_side(_target(titles, user)), "title")
    measured = both.groupBy("user_id").agg(F.count("rating").alias("shared"), pearson(F.col("rating"), F.col("own")).alias("corr"))
    if min_bin is not None or above_bin is not None:
        measured = reused(measured)
        number = sharing_bin(measured)
        measured = measured.filter(number >= min_bin if min_bin is not None else number > above_bin)
    if more_than is not None:
        measured = measured.filter(F.col("shared") > more_than)
    return measured.filter((F.col("user_id") != user) & (F.round("corr", TIE_DECIMALS) >= min_corr))


def user_based_scores(ratings: DataFrame, similar: DataFrame) -> DataFrame:
    """Mean of correlation times rating over all ratings of the similar users, per title."""
    weighted = ratings.join(small_side(similar.select("user_id", "corr")), "user_id")
    return weighted.groupBy("title").agg(F.avg(F.col("corr") * F.col("rating")).alias("score"))


def without_seen(scores: DataFrame, ratings: DataFrame, user: int) -> DataFrame:
    """Leave out titles the user has rated already."""
    seen = ratings.filter(F.col("user_id") == user).select("title").distinct()
    return scores.join(seen, "title", "left_anti")


def ranked(scores: DataFrame, score: str, count: int) -> DataFrame:
    """Best ``count`` titles with their position; equal scores in title order."""
    best = scores.orderBy(F.round(score, TIE_DECIMALS).desc(), "title").limit(count)
    order = Window.orderBy(F.round(score, TIE_DECIMALS).desc(), "title")  # over the limited rows only
    return best.withColumn("position", F.row_number().over(order))


def seed_title(ratings: DataFrame, titles: DataFrame, user: int, rating: float | None = None) -> Column:
    """The user's latest title with the given rating (by default the highest in the table) among the popular ones."""
    top = ratings.agg(F.max("rating")).scalar() if rating is None else F.lit(rating)
    mine = ratings.filter((F.col("user_id") == user) & (F.col("rating") == top))
    known = titles.filter(F.col("user_id") == user).select("title").distinct()
    return mine.join(known, "title", "left_semi").agg(F.max_by("title", F.struct("ts", "title"))).scalar()


def title_correlations(titles: DataFrame, seed: Column, min_common: int = 2) -> DataFrame:
    """Correlation of every title with the seed title over the users who rated both."""
    base = titles.filter(F.col("title") == seed).select("user_id", F.col("rating").alias("seed_rating"))
    both = titles.join(base, "user_id")
    measured = both.groupBy("title").agg(F.count("rating").alias("common"), pearson(F.col("rating"), F.col("seed_rating")).alias("corr"))
    return measured.filter((F.col("common") >= min_common) & F.col("corr").isNotNull())


def item_based(titles: DataFrame, seed: Column, count: int = 5, include_seed: bool = False, min_common: int = 2) -> DataFrame:
    found = title_correlations(titles, seed, min_common)
    if not include_seed:
        found = found.filter(F.col("title") != seed)
    return ranked(found, "corr", count)


def hybrid(user_list: DataFrame, item_list: DataFrame) -> DataFrame:
    """Both lists side by side by position."""
    left = user_list.select("position", F.col("title").alias("user_based"))
    right = item_list.select("position", F.col("title").alias("item_based"))
    return left.join(right, "position", "full_outer")


def external_ids(titles: DataFrame, catalogue: DataFrame, links: DataFrame) -> DataFrame:
    """Title to catalogue id to external id; unknown titles stay with null."""
    return titles.join(catalogue, "title", "left").join(links, "item_id", "left")
