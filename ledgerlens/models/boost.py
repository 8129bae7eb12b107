"""Adaptive boosting of one-split trees for two classes (Freund and Schapire 1997; Zhu et al. 2009)."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, astuple, dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.models.cells import EVERY_BAND, SCORES, Batch, Cells, HeldCells, candidate_splits, cell_table, dealt, held_at_once
from ledgerlens.session import reused

_TINY = 2.220446049250313e-16
#: Rounds after which the margins of all cells are written out.
WRITE_EVERY = 20
#: Splits whose impurities differ by less than this share are alike; the first one is taken.
ALIKE = 1e-10


@dataclass(frozen=True)
class Plan:
    """One model to be fitted on the bands up to ``band`` of all folds but ``held_out`` (-1: of all)."""

    rate: float
    by_label: bool
    held_out: int = -1
    band: int = EVERY_BAND


@dataclass(frozen=True)
class Stump:
    """What one round adds to the margin: ``left`` where the feature is at most the threshold, else ``right``."""

    feature: int
    threshold: float
    left: float
    right: float


def _applied(batch: Batch, pending: list[tuple[np.ndarray, ...]]) -> None:
    for feature, cut, left, right in pending:
        batch.margin += np.where(batch.bins[:, feature] <= cut, left, right)


def _best(h0: np.ndarray, h1: np.ndarray, widths: list[int]) -> tuple[np.ndarray, ...]:
    """For each plan the feature and bin with the least Gini impurity after the split, and the class weights on both sides."""
    plans = h0.shape[1]
    kept = np.full(plans, np.inf)
    feature, cut = np.zeros(plans, np.int64), np.full(plans, -1)
    sides = np.zeros((4, plans))
    total0, total1 = h0[: widths[0]].sum(0), h1[: widths[0]].sum(0)
    impure = lambda a, b: 2 * a * b / np.maximum(a + b, 1e-300)
    whole = impure(total0, total1)
    at = 0
    for f, width in enumerate(widths):
        left0, left1 = h0[at : at + width].cumsum(0)[:-1], h1[at : at + width].cumsum(0)[:-1]
        at += width
        if not len(left0):
            continue
        right0, right1 = np.maximum(total0 - left0, 0), np.maximum(total1 - left1, 0)
        cost = impure(left0, left1) + impure(right0, right1)
        least = cost.argmin(0)
        pick = (least, np.arange(plans))
        better = cost[pick] < np.minimum(kept, whole) - ALIKE * whole
        kept = np.where(better, cost[pick], kept)
        feature, cut = np.where(better, f, feature), np.where(better, least, cut)
        sides = np.where(better, np.stack([left0[pick], left1[pick], right0[pick], right1[pick]]), sides)
    # without a gain both sides are the whole
    none = cut < 0
    return feature, cut, *np.where(none, np.stack([total0, total1, total0, total1]), sides), total0, total1


def boosted(cells: Cells, splits: Sequence[Sequence[float]], plans: Sequence[Plan], rounds: int, score_at: Sequence[int] = ()) -> tuple[list[list[Stump]], list[list[float]], dict[int, np.ndarray]]:
    """Stumps and votes of every plan, and for each of ``score_at`` rounds the ``SCORES`` of every plan.

    All plans advance together, one aggregate a round. The margin of a cell is the sum of its stumps, and its weight follows
    from the margin, so nothing but margins is kept; a round depends on those before it alone, so the first n stumps
    are the model of n rounds. A plan that ends early (no error left, or none better than chance) adds nothing more.
    Few cells are held by tasks that take some plans each through all rounds.
    """
    if held_at_once(cells):
        def fit(held_cells: HeldCells, own: list[Plan]) -> tuple[list, dict[int, np.ndarray]]:
            stumps, votes, scores = _advanced(held_cells, splits, own, rounds, score_at)
            return [([astuple(s) for s in made], [float(v) for v in vote]) for made, vote in zip(stumps, votes, strict=True)], scores

        told, scores = dealt(cells, plans, fit)
        return [[Stump(*s) for s in made] for made, _ in told], [vote for _, vote in told], scores
    return _advanced(cells, splits, plans, rounds, score_at)


def _advanced(cells: Cells | HeldCells, splits: Sequence[Sequence[float]], plans: Sequence[Plan], rounds: int, score_at: Sequence[int]) -> tuple[list[list[Stump]], list[list[float]], dict[int, np.ndarray]]:
    widths = [len(s) + 1 for s in splits]
    offsets = np.concatenate([[0], np.cumsum(widths)])
    slots, count = int(offsets[-1]), len(plans)
    held, band = np.array([p.held_out for p in plans]), np.array([p.band for p in plans])
    by_label, rate = np.array([p.by_label for p in plans]), np.array([p.rate for p in plans])
    slope = np.where(by_label, 0.5, rate / 2)
    level, rows = np.zeros(count), np.zeros(count)  # the level keeps the sum of weights near the number of rows
    open_ = np.ones(count, bool)
    stumps: list[list[Stump]] = [[] for _ in plans]
    votes: list[list[float]] = [[] for _ in plans]
    pending: list[tuple[np.ndarray, ...]] = []
    scores: dict[int, np.ndarray] = {}

    for turn in range(rounds + 1):
        scoring, last = turn in score_at, turn == rounds
        if last and not scoring:
            break

        def work(batch: Batch, pending=tuple(pending), level=level.copy()) -> tuple[np.ndarray, np.ndarray]:
            _applied(batch, pending)
            sign = 2 * batch.label - 1
            out = np.zeros((2, slots + len(SCORES), count))
            if not last:
                weight = batch.weights(held, band) * np.exp(level - slope * sign[:, None] * batch.margin) 
                one = batch.label == 1
                for f, width in enumerate(widths):
                    places = (batch.bins[:, f][:, None] == np.arange(width)).astype(float)
                    out[0, offsets[f] : offsets[f] + width] = places[~one].T @ weight[~one]
                    out[1, offsets[f] : offsets[f] + width] = places[one].T @ weight[one]
            if scoring:
                out[0, slots:] = batch.scores(held, band)
            return out[0].ravel(), out[1].ravel()

        sums = cells.summed(work, (slots + len(SCORES)) * count).reshape(2, slots + len(SCORES), count)
        if scoring:
            scores[turn] = sums[0, slots:]
        if last:
            break
        feature, cut, l0, l1, r0, r1, t0, t1 = _best(sums[0, :slots], sums[1, :slots], widths)
        left_one, right_one = l1 > l0, r1 > r0
        total = t0 + t1
        error = (np.where(left_one, l0, l1) + np.where(cut >= 0, np.where(right_one, r0, r1), 0)) / np.maximum(total, 1e-300)
        first = turn == 0
        stopped = open_ & by_label & (error >= 0.5)
        adds = open_ & (~stopped | first)
        with np.errstate(divide="ignore"):
            vote = np.where(by_label & ~stopped & (error > 0), rate * np.log((1 - error) / np.maximum(error, 1e-300)), 1.0)
        lean = lambda a, b: np.log(np.maximum(b / np.maximum(a + b, 1e-300), _TINY)) - np.log(np.maximum(a / np.maximum(a + b, 1e-300), _TINY))
        left = np.where(by_label, vote * np.where(left_one, 1.0, -1.0), lean(l0, l1)) * adds
        right = np.where(by_label, vote * np.where(right_one, 1.0, -1.0), lean(r0, r1)) * adds
        for p in np.flatnonzero(adds):
            threshold = splits[feature[p]][cut[p]] if cut[p] >= 0 else math.inf
            stumps[p].append(Stump(int(feature[p]), float(threshold), float(left[p]), float(right[p])))
            votes[p].append(float(vote[p]))
        cut = np.where(cut >= 0, cut, 1 << 30)
        pending.append((feature, cut, left, right))
        rows = total if first else rows
        level = np.where(total > 0, level - np.log(np.maximum(total, 1e-300) / np.maximum(rows, 1e-300)), level)
        open_ &= ~(stopped | (error <= 0))
        if not open_.any() and not any(n > turn for n in score_at):
            break
        if turn + 1 < rounds:
            after = cells.carried(lambda batch, steps=tuple(pending): _applied(batch, steps), len(pending), WRITE_EVERY)
            cells, pending = (cells, pending) if after is None else (after, [])
    cells.release()
    return stumps, votes, scores


class _BoostParams(HasFeaturesCol, HasLabelCol, HasSeed):
    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    algorithm = Param(Params._dummy(), "algorithm", "SAMME (labels) or SAMME.R (probabilities)", TypeConverters.toString)


class AdaBoostClassifier(Estimator, _BoostParams):
    """Each round fits a tree with one split on weighted rows; rows it gets wrong weigh more in the next.

    Features are cut at up to 31 thresholds, and equal rows are counted once, so a round is one aggregate over cells.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=50, rate=1.0, algorithm="SAMME.R", seed=42):
        super().__init__()
        self._setDefault(rounds=50, rate=1.0, algorithm="SAMME.R")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        by_label = self.getOrDefault("algorithm") == "SAMME"
        rows = reused(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), self.getLabelCol()))
        splits = candidate_splits(rows, "x")
        plan = Plan(self.getOrDefault("rate"), by_label)
        stumps, votes, _ = boosted(cell_table(rows, "x", self.getLabelCol(), F.lit(0), splits, 1), splits, [plan], self.getOrDefault("rounds"))
        rows.unpersist()
        return self._copyValues(AdaBoostModel(stumps[0], votes[0], by_label))


class AdaBoostModel(Model, _BoostParams):
    """The stumps and their votes; adds ``rawPrediction``, ``probability`` and ``prediction``."""

    def __init__(self, stumps: Sequence[Stump] = (), votes: Sequence[float] = (), by_label: bool = False):
        super().__init__()
        self.stumps, self.votes, self.by_label = list(stumps), list(votes), by_label

    def _sum(self, count: int | None = None) -> Column:
        """The margin's sum as one pass over an array of constants, so the plan does not grow with the rounds."""
        if not self.stumps[:count]:
            return F.lit(0.0)
        told = [asdict(s) | {"threshold": min(s.threshold, 1.7976931348623157e308)} for s in self.stumps[:count]]
        steps = F.from_json(F.lit(json.dumps(told)), "array<struct<feature:int,threshold:double,left:double,right:double>>")
        x = vector_to_array(self.getFeaturesCol())
        return F.aggregate(steps, F.lit(0.0), lambda total, s: total + F.when(F.get(x, s["feature"]) <= s["threshold"], s["left"]).otherwise(s["right"]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scale = sum(self.votes) if self.by_label else float(max(1, len(self.stumps)))
        told = dataset.withColumn("_margin", self._sum() / F.lit(scale))
        margin = F.col("_margin")
        one = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return (
            told.withColumn("rawPrediction", array_to_vector(F.array(-margin, margin)))
            .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - one, one)))
            .withColumn("prediction", (margin > 0).cast("double"))
            .drop("_margin")
        )

    def staged(self, dataset: DataFrame, rounds: Sequence[int]) -> Iterator[tuple[int, DataFrame]]:
        """``(n, dataset with the prediction of the first n trees)`` for each of ``rounds``, in ascending order."""
        for n in sorted(rounds):
            yield n, dataset.withColumn("prediction", (self._sum(n) > 0).cast("double"))
