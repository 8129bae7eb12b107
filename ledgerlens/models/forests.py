"""Bagged and extremely random trees for two classes (Breiman 1996; Geurts, Ernst and Wehenkel 2006).

All trees of a forest grow together on binned rows, one aggregate a level. A row's weight in a bagged tree is a Poisson draw
from a hash of its key and the tree's number, so nothing is sampled twice alike and a recomputed partition draws the same.
Extremely random trees take all rows; at each node they try one threshold per feature, drawn among those that part the node.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.models.cells import Batch, candidate_splits, cell_table, summed
from ledgerlens.models.newton import LEFT, NewtonBoostModel, Tree, _chosen, _placed
from ledgerlens.session import reused

#: Chance of at most 0, 1, 2, ... for a Poisson count of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def mixed(*parts: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from whole numbers, the same on every machine (the finaliser of MurmurHash3 after each part)."""
    h = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            h = h ^ (h >> np.uint64(33))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _drawn(weight: np.ndarray, widths: list[int], level: int, seed: int) -> np.ndarray:
    """For each (node, plan) the one cut of every feature that may be taken, as a mask over (node, slot, plan)."""
    nodes, _, plans = weight.shape
    allowed = np.zeros(weight.shape, bool)
    node, plan = np.arange(nodes)[:, None], np.arange(plans)[None, :]
    features = max(1, round(math.sqrt(len(widths))))
    # the features of a node: those with the smallest draws, of all that part its rows
    order, at = np.full((len(widths), nodes, plans), np.inf), 0
    cuts = np.zeros((len(widths), nodes, plans), np.int64)
    for f, width in enumerate(widths):
        some = weight[:, at : at + width] > 0
        low, high = some.argmax(1), width - 1 - some[:, ::-1].argmax(1)
        cuts[f] = at + low + np.floor(mixed(seed, level, node, plan, f) * np.maximum(high - low, 1)).astype(np.int64)
        order[f] = np.where(some.any(1) & (high > low), mixed(seed + 1, level, node, plan, f), np.inf)
        at += width
    limit = np.sort(order, 0)[min(features, len(widths)) - 1]
    for f in range(len(widths)):
        n, p = np.nonzero((order[f] <= limit) & np.isfinite(order[f]))
        allowed[n, cuts[f][n, p], p] = True
    return allowed


class _ForestParams(HasFeaturesCol, HasLabelCol, HasSeed):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    key = Param(Params._dummy(), "key", "column whose hash draws a row's weights", TypeConverters.toString)
    random_splits = Param(Params._dummy(), "random_splits", "thresholds drawn at random, all rows in every tree", TypeConverters.toBoolean)


class TreesClassifier(Estimator, _ForestParams):
    """Bagged trees, or with ``random_splits`` extremely random ones; the mean of their class shares decides."""

    @keyword_only
    def __init__(self, *, key, featuresCol="features", labelCol="label", trees=10, depth=8, random_splits=False, seed=42):
        super().__init__()
        self._setDefault(trees=10, depth=8, random_splits=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TreesModel:
        rows = reused(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), self.getLabelCol(), F.hash(self.getOrDefault("key")).alias("h")))
        splits = candidate_splits(rows, "x")
        count, depth, seed = self.getOrDefault("trees"), self.getOrDefault("depth"), self.getSeed()
        free = self.getOrDefault("random_splits")
        widths = [len(s) + 1 for s in splits]
        offsets = np.concatenate([[0], np.cumsum(widths)])
        slots, number = int(offsets[-1]), np.arange(count)
        # the fold of a cell is the hash of its key here
        cells = cell_table(rows, "x", self.getLabelCol(), F.col("h"), splits, count)
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        values = np.zeros((1, count))
        for level in range(depth):
            nodes = 1 << level

            def work(batch: Batch, levels=tuple(levels), nodes=nodes) -> tuple[np.ndarray, np.ndarray]:
                draw = 1.0 if free else np.searchsorted(POISSON, mixed(batch.fold[:, None], number[None, :], seed), "right")
                weight = (batch.n[:, None] * draw * np.ones(count)).ravel()
                hits = weight * np.repeat(batch.label, count)
                node = _placed(batch, levels)
                first, second = np.zeros(nodes * slots * count), np.zeros(nodes * slots * count)
                for f in range(len(widths)):
                    place = ((node * slots + offsets[f] + batch.bins[:, f][:, None]) * count + number).ravel()
                    first += np.bincount(place, hits, len(first))
                    second += np.bincount(place, weight, len(second))
                return first, second

            hits, weight = (v.reshape(nodes, slots, count) for v in summed(cells, work, nodes * slots * count))
            allowed = _drawn(weight, widths, level, seed) if free else None
            feature, cut, lg, lh, rg, rh = _chosen(-hits, weight, widths, np.full(count, 1e-9), np.full(count, 1.0), allowed)
            levels.append((feature, cut))
            shares = np.stack([-lg / np.maximum(lh, 1e-9), -rg / np.maximum(rh, 1e-9)], 1)
            kept = np.where(lh + rh > 0, -(lg + rg) / np.maximum(lh + rh, 1e-9), 0)
            # nodes without a split hand their share down, empty ones their parent's
            whole = np.where(lh + rh > 0, np.where(cut < LEFT, 0, shares[:, 0]), values) if level else kept
            values = np.where(np.repeat(cut, 2, 0) < LEFT, shares.reshape(2 * nodes, count), np.repeat(whole, 2, 0))
        cells.release()
        rows.unpersist()
        made = []
        for p in range(count):
            thresholds = [[splits[f][c] if c < LEFT else math.inf for f, c in zip(feature[:, p], cut[:, p], strict=True)] for feature, cut in levels]
            made.append(Tree([feature[:, p].tolist() for feature, _ in levels], thresholds, values[:, p].tolist()))
        return self._copyValues(TreesModel(made))


class TreesModel(NewtonBoostModel, _ForestParams):
    """Mean share of class 1 over the trees; adds ``rawPrediction``, ``probability`` and ``prediction``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        share = self.margin(vector_to_array(self.getFeaturesCol())) / F.lit(float(max(1, len(self.trees))))
        told = dataset.withColumn("_share", share)
        both = array_to_vector(F.array(F.lit(1.0) - F.col("_share"), F.col("_share")))
        return told.withColumn("rawPrediction", both).withColumn("probability", both).withColumn("prediction", (F.col("_share") > 0.5).cast("double")).drop("_share")
