"""Level-based segments: a persona key, the table of expected prices, and the lookup of new users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import joined_key, normalized_code
from ledgerlens.operators.binning import age_band
from ledgerlens.plans.cltv import with_value_segment
from ledgerlens.session import reused

# Closed age bands of the persona key.
AGE_BANDS = ((0, 18), (19, 23), (24, 30), (31, 40), (41, 66), (67, 100))


def persona_key(parts: Sequence[Column], age: Column) -> Column:
    """Normalised parts and the age band, joined; null when a part is missing or the age lies outside the bands."""
    return joined_key([*[normalized_code(p) for p in parts], age_band(age, AGE_BANDS)])


def level_table(spending: DataFrame, key: str, price: str) -> DataFrame:
    """Mean price per persona and its quarter (A the best)."""
    levels = reused(spending.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(price).alias("price")))
    return with_value_segment(levels, "price", rows=levels.count())


def looked_up(users: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """Expected price (two decimals) and segment of each user; ``has_data`` is false for unknown personas."""
    found = users.join(levels.select(key, "price", "segment"), key, "left")
    return found.withColumns({"has_data": F.col("segment").isNotNull(), "price": F.bround("price", 2)})
