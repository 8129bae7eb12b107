"""Second-order gradient boosting on histograms for two classes (Friedman 2001; Chen and Guestrin 2016)."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.models.cells import EVERY_BAND, SCORES, Batch, Cells, HeldCells, candidate_splits, cell_table, dealt, held_at_once
from ledgerlens.session import reused

#: Rounds after which the margins of all cells are written out.
WRITE_EVERY = 10
ALIKE = 1e-9
LEFT = 1 << 30


@dataclass(frozen=True)
class Plan:
    """One model to be fitted on the bands up to ``band`` of all folds but ``held_out`` (-1: of all)."""

    rate: float
    depth: int
    held_out: int = -1
    ridge: float = 1.0
    least_weight: float = 1.0
    band: int = EVERY_BAND


@dataclass(frozen=True)
class Tree:
    """Splits level by level (node k of a level goes to 2k or 2k + 1) and the value of every leaf."""

    features: list[list[int]]
    thresholds: list[list[float]]
    leaves: list[float]


def _placed(batch: Batch, levels: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The node of every (cell, plan) below the given levels; a level is (feature, cut), each by node and plan."""
    rows, plans = batch.margin.shape
    node = np.zeros((rows, plans), np.int64)
    row, plan = np.arange(rows)[:, None], np.arange(plans)[None, :]
    for feature, cut in levels:
        node = 2 * node + (batch.bins[row, feature[node, plan]] > cut[node, plan])
    return node


def _applied(batch: Batch, trees: Sequence[tuple]) -> None:
    plan = np.arange(batch.margin.shape[1])[None, :]
    for levels, leaves in trees:
        batch.margin += leaves[_placed(batch, levels), plan]


def _slopes(batch: Batch, held: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, zero for cells a plan is not trained on."""
    p = 1 / (1 + np.exp(-batch.margin))
    n = batch.weights(held, band)
    return n * (p - batch.label[:, None]), n * np.maximum(p * (1 - p), 1e-16)


def _chosen(g: np.ndarray, h: np.ndarray, widths: Sequence[int], ridge: np.ndarray, least: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The split of largest gain for each (node, plan): feature, cut, and the sums on both sides; sums are (node, slot, plan).

    ``allowed`` may bar cuts, by the slot of the last bin on the left.
    """
    nodes, _, plans = g.shape
    whole_g, whole_h = g[:, : widths[0]].sum(1), h[:, : widths[0]].sum(1)
    worth = lambda a, b: a * a / (b + ridge)
    best = np.full((nodes, plans), 1e-6)
    feature, cut = np.zeros((nodes, plans), np.int64), np.full((nodes, plans), LEFT)
    left_g, left_h = whole_g.copy(), whole_h.copy()
    at = 0
    for f, width in enumerate(widths):
        lg, lh = g[:, at : at + width].cumsum(1)[:, :-1], h[:, at : at + width].cumsum(1)[:, :-1]
        free = None if allowed is None else allowed[:, at : at + width - 1]
        at += width
        if not lg.shape[1]:
            continue
        rg, rh = whole_g[:, None] - lg, whole_h[:, None] - lh
        gain = worth(lg, lh) + worth(rg, rh) - worth(whole_g, whole_h)[:, None]
        gain = np.where((lh >= least) & (rh >= least) & (True if free is None else free), gain, -np.inf)
        # of gains that are alike the first one, so that the order of sums does not decide
        top = gain.max(1, keepdims=True)
        pick = (gain >= np.where(np.isfinite(top), top - ALIKE * np.abs(top), top)).argmax(1)[:, None]
        top = top[:, 0]
        better = top > best * (1 + ALIKE)
        best = np.where(better, top, best)
        feature, cut = np.where(better, f, feature), np.where(better, pick[:, 0], cut)
        left_g = np.where(better, np.take_along_axis(lg, pick, 1)[:, 0], left_g)
        left_h = np.where(better, np.take_along_axis(lh, pick, 1)[:, 0], left_h)
    return feature, cut, left_g, left_h, whole_g - left_g, whole_h - left_h


def newton_boosted(cells: Cells, splits: Sequence[Sequence[float]], plans: Sequence[Plan], rounds: int, score_at: Sequence[int] = ()) -> tuple[list[list[Tree]], dict[int, np.ndarray]]:
    """Trees of every plan, and for each of ``score_at`` rounds the ``SCORES`` of every plan.

    All plans grow their trees together, level by level: one aggregate of first and second derivatives a level, in which
    plans of less depth no longer take part. The first n trees are the model of n rounds. Few cells are held by tasks that
    grow the trees of some plans each.
    """
    if held_at_once(cells):
        def fit(held_cells: HeldCells, own: list[Plan]) -> tuple[list, dict[int, np.ndarray]]:
            trees, scores = _grown(held_cells, splits, own, rounds, score_at)
            return [[astuple(t) for t in made] for made in trees], scores

        told, scores = dealt(cells, plans, fit)
        return [[Tree(*t) for t in made] for made in told], scores
    return _grown(cells, splits, plans, rounds, score_at)


def _grown(cells: Cells | HeldCells, splits: Sequence[Sequence[float]], plans: Sequence[Plan], rounds: int, score_at: Sequence[int]) -> tuple[list[list[Tree]], dict[int, np.ndarray]]:
    widths = [len(s) + 1 for s in splits]
    offsets = np.concatenate([[0], np.cumsum(widths)])
    slots, count = int(offsets[-1]), len(plans)
    held, band, depth = (np.array([getattr(p, c) for p in plans]) for c in ("held_out", "band", "depth"))
    rate, ridge, least = (np.array([getattr(p, c) for p in plans]) for c in ("rate", "ridge", "least_weight"))
    deepest = int(depth.max())
    trees: list[list[Tree]] = [[] for _ in plans]
    scores: dict[int, np.ndarray] = {}
    pending: list[tuple] = []

    for turn in range(rounds + 1):
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        values = np.zeros((1, count))
        for level in range(deepest if turn < rounds else 1):
            scoring, last = level == 0 and turn in score_at, turn == rounds
            if last and not scoring:
                break
            active = np.flatnonzero(depth > level)
            nodes = 1 << level
            size = nodes * slots * len(active)

            def work(batch: Batch, trees=tuple(pending), levels=tuple(levels), active=active, nodes=nodes, size=size, scoring=scoring, last=last) -> tuple[np.ndarray, np.ndarray]:
                _applied(batch, trees)
                first, second = np.zeros(size + len(SCORES) * count), np.zeros(size + len(SCORES) * count)
                if not last:
                    g, h = _slopes(batch, held, band)
                    g, h, node = g[:, active].ravel(), h[:, active].ravel(), _placed(batch, levels)[:, active]
                    for f, width in enumerate(widths):
                        place = ((node * slots + offsets[f] + batch.bins[:, f][:, None]) * len(active) + np.arange(len(active))).ravel()
                        first[:size] += np.bincount(place, g, size)
                        second[:size] += np.bincount(place, h, size)
                if scoring:
                    first[size:] = batch.scores(held, band).ravel()
                return first, second

            first, second = cells.summed(work, size + len(SCORES) * count)
            if scoring:
                scores[turn] = first[size:].reshape(len(SCORES), count)
            if last:
                break
            feature, cut = np.zeros((nodes, count), np.int64), np.full((nodes, count), LEFT)
            shape = (nodes, slots, len(active))
            found = _chosen(first[:size].reshape(shape), second[:size].reshape(shape), widths, ridge[active], least[active])
            feature[:, active], cut[:, active] = found[0], found[1]
            levels.append((feature, cut))
            # what a leaf adds is known from the sums of its parent's split
            below = np.repeat(values, 2, 0)
            step = rate[active] * np.stack([-found[2] / (found[3] + ridge[active]), -found[4] / (found[5] + ridge[active])], 1)
            below[:, active] = np.where(np.repeat(found[1], 2, 0) < LEFT, step.reshape(2 * nodes, -1), np.repeat(step[:, 0], 2, 0))
            values = below
        if turn == rounds:
            break
        for p in range(count):
            kept = levels[: depth[p]]
            thresholds = [[splits[f][c] if c < LEFT else math.inf for f, c in zip(feature[:, p], cut[:, p], strict=True)] for feature, cut in kept]
            leaves = values[:: 1 << (deepest - depth[p]), p]
            trees[p].append(Tree([feature[:, p].tolist() for feature, _ in kept], thresholds, leaves.tolist()))
        pending.append((tuple(levels), values))
        if turn + 1 < rounds:
            after = cells.carried(lambda batch, steps=tuple(pending): _applied(batch, steps), len(pending), WRITE_EVERY)
            cells, pending = (cells, pending) if after is None else (after, [])
    cells.release()
    return trees, scores


class _NewtonParams(HasFeaturesCol, HasLabelCol):
    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate, of any size", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)


class NewtonBoostClassifier(Estimator, _NewtonParams):
    """Boosted trees whose splits and leaves follow from first and second derivatives of the logistic loss."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=100, rate=0.3, depth=6):
        super().__init__()
        self._setDefault(rounds=100, rate=0.3, depth=6)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NewtonBoostModel:
        rows = reused(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), self.getLabelCol()))
        splits = candidate_splits(rows, "x")
        plan = Plan(self.getOrDefault("rate"), self.getOrDefault("depth"))
        trees, _ = newton_boosted(cell_table(rows, "x", self.getLabelCol(), F.lit(0), splits, 1), splits, [plan], self.getOrDefault("rounds"))
        rows.unpersist()
        return self._copyValues(NewtonBoostModel(trees[0]))


class NewtonBoostModel(Model, _NewtonParams):
    """The trees; adds ``rawPrediction``, ``probability`` and ``prediction``."""

    def __init__(self, trees: Sequence[Tree] = ()):
        super().__init__()
        self.trees = list(trees)

    def margin(self, features: Column) -> Column:
        """Sum of the leaves a row falls into; trees are constants of one array, walked level by level."""
        if not self.trees:
            return F.lit(0.0)
        kind = "array<struct<features:array<array<int>>,thresholds:array<array<double>>,leaves:array<double>>>"
        high = 1.7976931348623157e308
        told = [{"features": t.features, "thresholds": [[min(v, high) for v in level] for level in t.thresholds], "leaves": t.leaves} for t in self.trees]
        trees = F.from_json(F.lit(json.dumps(told)), kind)

        # row and node are lambda variables: written out, each level would repeat the expression of the one above three times
        def leaf(tree: Column, row: Column) -> Column:
            levels = F.arrays_zip(tree["features"].alias("f"), tree["thresholds"].alias("t"))

            def below(node: Column, level: Column) -> Column:
                right = F.get(row, F.get(level["f"], node)) > F.get(level["t"], node)
                return node * 2 + F.when(right, 1).otherwise(0)

            return F.get(tree["leaves"], F.aggregate(levels, F.lit(0), below))

        rows = F.transform(F.array(features), lambda row: F.aggregate(trees, F.lit(0.0), lambda total, tree: total + leaf(tree, row)))
        return F.get(rows, 0)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = dataset.withColumn("_margin", self.margin(vector_to_array(self.getFeaturesCol())))
        margin = F.col("_margin")
        one = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return (
            told.withColumn("rawPrediction", array_to_vector(F.array(-margin, margin)))
            .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - one, one)))
            .withColumn("prediction", (margin > 0).cast("double"))
            .drop("_margin")
        )
