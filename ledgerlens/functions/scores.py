"""Rating and ranking scores as column expressions or single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper limits of the day and progress bands, and the band weights in percent.
DAY_LIMITS = (30, 90, 180)
DAY_WEIGHTS = (28, 26, 24, 22)
PROGRESS_LIMITS = (10, 45, 75)
PROGRESS_WEIGHTS = (22, 24, 26, 28)


def two_sided_z(confidence: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def banded_mean(rating: Column, measure: Column, limits: Sequence[float], weights: Sequence[float]) -> Column:
    """Aggregate: weighted sum of the mean ratings in each band of ``measure``; null when a band is empty."""
    total = None
    lower = None
    for upper, weight in zip([*limits, None], weights):
        inside = F.lit(True) if upper is None else measure <= F.lit(upper)
        if lower is not None:
            inside = inside & (measure > F.lit(lower))
        term = F.avg(F.when(inside, rating)) * F.lit(float(weight)) / F.lit(100.0)
        total = term if total is None else total + term
        lower = upper
    return total


def time_weighted_mean(rating: Column, days: Column, weights: Sequence[float] = DAY_WEIGHTS) -> Column:
    return banded_mean(rating, days, DAY_LIMITS, weights)


def progress_weighted_mean(rating: Column, progress: Column, weights: Sequence[float] = PROGRESS_WEIGHTS) -> Column:
    return banded_mean(rating, progress, PROGRESS_LIMITS, weights)


def course_ratings(df: DataFrame, by: Sequence[str] = (), rating: str = "rating", days: str = "days", progress: str = "progress", time_weight: float = 50, user_weight: float = 50) -> DataFrame:
    """Time-weighted, progress-weighted and combined rating, overall or per group."""
    scored = df.groupBy(*by).agg(
        time_weighted_mean(F.col(rating), F.col(days)).alias("time_weighted"),
        progress_weighted_mean(F.col(rating), F.col(progress)).alias("user_weighted"),
    )
    combined = F.col("time_weighted") * (time_weight / 100) + F.col("user_weighted") * (user_weight / 100)
    return scored.withColumn("course_rating", combined)


def weighted_sorting_score(comments_scaled: Column, purchases_scaled: Column, rating: Column, weights: Sequence[float] = (32, 26, 42)) -> Column:
    parts = [c * F.lit(float(w)) / F.lit(100.0) for c, w in zip((comments_scaled, purchases_scaled, rating), weights)]
    return parts[0] + parts[1] + parts[2]


def bayesian_average_rating(star_counts: Sequence[Column], confidence: float = 0.95) -> Column:
    """Lower bound of the mean star rating with one prior vote per star; 0 without votes.

    ``star_counts`` are the counts of 1 star, 2 stars and so on.
    """
    kinds = len(star_counts)
    votes = star_counts[0].cast("double")
    for c in star_counts[1:]:
        votes = votes + c
    total = votes + F.lit(float(kinds))
    first, second = F.lit(0.0), F.lit(0.0)
    for stars, c in enumerate(star_counts, start=1):
        share = (c + F.lit(1.0)) / total
        first = first + share * F.lit(float(stars))
        second = second + share * F.lit(float(stars * stars))
    bound = first - F.lit(two_sided_z(confidence)) * F.sqrt((second - first * first) / (total + F.lit(1.0)))
    return F.when(votes == 0, F.lit(0.0)).otherwise(bound)


def hybrid_sorting_score(star_counts: Sequence[Column], comments_scaled: Column, purchases_scaled: Column, rating: Column, bar_weight: float = 60, sort_weight: float = 40) -> Column:
    bar = bayesian_average_rating(star_counts)
    sort = weighted_sorting_score(comments_scaled, purchases_scaled, rating)
    return bar * F.lit(bar_weight / 100) + sort * F.lit(sort_weight / 100)


def shrunk_rating(rating: Column, votes: Column, minimum_votes: Column, overall_mean: Column) -> Column:
    """Rating pulled towards the overall mean; the fewer votes, the stronger. Null when both vote counts are 0."""
    total = votes + minimum_votes
    return F.try_divide(votes, total) * rating + F.try_divide(minimum_votes, total) * overall_mean


def up_down_difference(up: Column, down: Column) -> Column:
    return up - down


def up_share(up: Column, down: Column) -> Column:
    """Share of up votes; 0 without votes."""
    return F.when(up + down == 0, F.lit(0.0)).otherwise(F.try_divide(up, up + down))


def wilson_lower_bound(up: Column, down: Column, confidence: float = 0.95) -> Column:
    """Lower end of the Wilson interval of the up share; 0 without votes."""
    z = two_sided_z(confidence)
    n = F.nullif((up + down).cast("double"), F.lit(0.0))
    share = up / n
    spread = F.sqrt((share * (F.lit(1.0) - share) + F.lit(z * z) / (F.lit(4.0) * n)) / n)
    bound = (share + F.lit(z * z) / (F.lit(2.0) * n) - F.lit(z) * spread) / (F.lit(1.0) + F.lit(z * z) / n)
    return F.when(up + down == 0, F.lit(0.0)).otherwise(bound)
