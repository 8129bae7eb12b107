"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized

MAX_ROUNDS = 100


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index of each set) after the sets of a[i] and b[i] are joined, for every i."""
    while True:
        left, right = label[a], label[b]
        differ = left != right
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        low, high = np.minimum(left[differ], right[differ]), np.maximum(left[differ], right[differ])
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("high", "low")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a and b): the smallest node that can be reached.

    Each round hangs larger neighbours (large star), then smaller ones (small star), on the smallest neighbour of a node;
    the edge count never grows, and rounds are about the logarithm of the longest path. Every round is written to the
    shared folder, so a lost executor costs one round at most. Neighbourhoods are aggregated with map-side combine, never
    listed; edges of a hub are joined to its one row of minima, which the adaptive skew join can split.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    now = materialized(now, "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).where("high <> low").distinct()
        below = large.groupBy("high").agg(F.min("low").alias("m"))
        hung = large.join(below, "high").select(F.explode(F.array(F.struct(F.col("low").alias("high"), F.col("m").alias("low")), F.struct(F.col("high"), F.col("m").alias("low")))).alias("e"))
        after = materialized(hung.select("e.high", "e.low").where("high <> low").distinct(), "edges")
        now, earlier, state = after, state, _state(after)
        if state == earlier:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    own = now.select(F.col("low").alias("node"), F.col("low").alias("label")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("label")).unionAll(own)
