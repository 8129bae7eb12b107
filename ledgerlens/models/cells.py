"""Binned training rows collapsed into weighted cells, on which boosting advances many models at once.

A feature is cut at a few candidate thresholds, so rows with equal bins, label and fold behave alike in every tree and become
one cell with a count. A model is a *plan*; all plans, and all folds of a cross-validation, advance in the same rounds: a round is one pass over
the cells, from which only weighted counts by (plan, node, feature, bin) come back.

Plans do not depend on each other. Up to ``HELD_CELLS`` cells (of any number of rows) a task holds them all and takes its
plans through every round itself, by the same steps, so that no round costs a job; the plans are dealt out to tasks.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.order_stats import quantiles
from ledgerlens.session import materialized, reused

BINS = 32
#: Numbers a task holds at once: cells of a partition times plans.
STATE = 4_000_000
#: Cells that one task may hold, and tasks that plans are dealt to at most.
HELD_CELLS = 1 << 16
HELD_TASKS = 32


def candidate_splits(df: DataFrame, features: str, bins: int = BINS) -> list[list[float]]:
    """Thresholds of each entry of the array column ``features``, ascending; a row goes left where its value is at most one.

    An entry with up to ``bins`` distinct values is cut between all of them, another one at its quantiles.
    """
    pairs = reused(df.select(F.posexplode(features).alias("feature", "value")).where("value IS NOT NULL").distinct())
    sizes = {r["feature"]: r["n"] for r in pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [f for f, n in sizes.items() if n <= bins]
    listed = pairs.where(F.col("feature").isin(few)).collect() if few else []
    found: list[list[float]] = [[] for _ in range(max(sizes, default=-1) + 1)]
    for f in few:
        values = sorted(r["value"] for r in listed if r["feature"] == f)
        found[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    many = [f for f in sizes if f not in few]
    if many:
        wide = df.select(*[F.get(features, f).alias(f"f{f}") for f in many])
        edges = quantiles(wide, {f"f{f}": [k / bins for k in range(1, bins)] for f in many})
        for f in many:
            found[f] = sorted({e for e in edges[f"f{f}"] if e is not None})
    pairs.unpersist()
    return found


def binned(features: str, splits: Sequence[Sequence[float]]) -> Column:
    """Number of thresholds below each entry; a null entry is below all of them."""

    def place(entry: int, thresholds: Sequence[float]) -> Column:
        below = F.filter(F.lit([float(t) for t in thresholds]), lambda t: t < F.get(F.col(features), entry))
        return F.size(below) if thresholds else F.lit(0)

    return F.array(*[place(i, s) for i, s in enumerate(splits)])


@dataclass(frozen=True)
class Cells:
    """A kept table of cells (bins, fold, band, label, n, margin) in so many partitions."""

    table: DataFrame
    parts: int
    rows: int | None = None

    def release(self) -> None:
        self.table.unpersist()

    def summed(self, work: Callable[[Batch], tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
        return summed(self, work, slots)

    def carried(self, apply: Callable[[Batch], None], pending: int, most: int) -> Cells | None:
        """The cells brought up to date once ``most`` steps are pending, else nothing."""
        return carried(self, apply) if pending >= most else None


def cell_table(df: DataFrame, features: str, label: str, fold: Column, splits: Sequence[Sequence[float]], plans: int, band: Column | None = None) -> Cells:
    """Rows with equal bins, fold, band and 0/1 label counted; no plan has a margin yet. A plan takes bands up to its own."""
    band = F.lit(0) if band is None else band
    rows = df.select(binned(features, splits).alias("bins"), fold.cast("int").alias("fold"), band.cast("int").alias("band"), F.col(label).cast("double").alias("label"))
    cells = materialized(rows.groupBy("bins", "fold", "band", "label").agg(F.count(F.lit(1)).cast("double").alias("n")), "cells")
    count = cells.count()
    parts = max(1, -(-count * plans // STATE))
    none = F.array_repeat(F.lit(0.0), plans)
    spread = cells.repartition(parts, "bins", "fold", "band", "label") if parts > 1 else cells.coalesce(1)
    return Cells(reused(spread.withColumn("margin", none)), parts, count)


class Batch:
    """Cells of one record batch as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        rows = batch.num_rows
        self.bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
        self.fold, self.band, self.label, self.n = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEYS)
        self.margin = batch.column("margin").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).copy()

    def advanced(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The same cells with the margins as they are now."""
        at = pa.array(np.arange(len(self.margin) + 1, dtype=np.int32) * self.margin.shape[1])
        margin = pa.ListArray.from_arrays(at, pa.array(self.margin.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("bins", *KEYS)] + [margin], names=["bins", *KEYS, "margin"])

    def weights(self, held: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Counts of the cells each plan is trained on: outside its held-out fold and within its band."""
        return self.n[:, None] * ((self.fold[:, None] != held) & (self.band[:, None] <= band))

    def scores(self, held: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The rows of ``SCORES`` for each plan."""
        inside, apart = self.weights(held, band), self.n[:, None] * (self.fold[:, None] == held)
        told, true = self.margin > 0, (self.label == 1)[:, None]
        right = told == true
        parts = [apart * (told & true), apart * (told & ~true), apart * (~told & true), apart * right, apart, inside * right, inside]
        return np.stack([p.sum(0) for p in parts])


KEYS = ("fold", "band", "label", "n")
#: Hits, false alarms and misses of class 1, right answers and rows of the held-out fold, right answers and rows of the training part.
SCORES = ("hit", "false", "missed", "right", "rows", "train_right", "train_rows")
EVERY_BAND = 1 << 30
CELL_SCHEMA = "bins array<int>, fold int, band int, label double, n double, margin array<double>"


def summed(cells: Cells, work: Callable[[Batch], tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """Two sums for each of ``slots`` numbered places, over all cells: one pass, and one aggregate with map-side combine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(slots), np.zeros(slots)
        for batch in batches:
            if batch.num_rows:
                a, b = work(Batch(batch))
                first += a
                second += b
        some = np.flatnonzero((first != 0) | (second != 0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(first[some]), pa.array(second[some])], names=["slot", "a", "b"])

    rows = cells.table.mapInArrow(run, "slot long, a double, b double")
    found = rows.groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    out = np.zeros((2, slots))
    slot = found.column("slot").to_numpy()
    out[0, slot], out[1, slot] = found.column("a").to_numpy(), found.column("b").to_numpy()
    return out


def carried(cells: Cells, apply: Callable[[Batch], None]) -> Cells:
    """The cells with margins brought up to date and written: what a lost executor can cost is bounded by this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = Batch(batch)
                apply(own)
                yield own.advanced(batch)

    after = materialized(cells.table.mapInArrow(run, CELL_SCHEMA), "cells")
    cells.release()
    return Cells(reused(after.coalesce(cells.parts)), cells.parts, cells.rows)


class HeldCells:
    """All cells of some plans, held in a task: what ``Cells`` does by a job is done in place."""

    def __init__(self, table: pa.Table, plans: int):
        bins = table.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        order = np.lexsort([*bins.T[::-1], *[table.column(c).to_numpy() for c in ("label", "band", "fold")]])
        rows = table.select(["bins", *KEYS]).take(pa.array(order)).combine_chunks()
        none = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * plans), pa.array(np.zeros(len(order) * plans)))
        self.batches = [Batch(b) for b in rows.append_column("margin", none).to_batches(max_chunksize=10_000) if b.num_rows]

    def release(self) -> None:
        self.batches = []

    def summed(self, work: Callable[[Batch], tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
        out = np.zeros((2, slots))
        for batch in self.batches:
            own = copy.copy(batch)
            own.margin = batch.margin.copy()
            first, second = work(own)
            out[0] += first
            out[1] += second
        return out

    def carried(self, apply: Callable[[Batch], None], pending: int, most: int) -> HeldCells:
        for batch in self.batches:
            apply(batch)
        return self


def dealt(cells: Cells, plans: Sequence, fit: Callable[[HeldCells, list], tuple[list, dict[int, np.ndarray]]]) -> tuple[list, dict[int, np.ndarray]]:
    """What ``fit`` makes of each plan (told as JSON), and the scores by round of all plans, each made in a task that holds the cells."""
    tasks = min(len(plans), HELD_TASKS)

    def run(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        own = [p for i, p in enumerate(plans) if i % tasks == task]
        made, scores = fit(HeldCells(table, len(own)), own)
        return pa.table({"task": pa.array([task], pa.int32()), "made": [json.dumps(made)], "scores": [json.dumps({n: v.tolist() for n, v in scores.items()})]})

    copies = cells.table.drop("margin").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "task")
    found = copies.groupBy("task").applyInArrow(run, "task int, made string, scores string").collect()
    cells.release()
    made: list = [None] * len(plans)
    scores: dict[int, np.ndarray] = {}
    for r in found:
        at = range(r["task"], len(plans), tasks)
        for i, m in zip(at, json.loads(r["made"]), strict=True):
            made[i] = m
        for turn, values in json.loads(r["scores"]).items():
            scores.setdefault(int(turn), np.zeros((len(SCORES), len(plans))))[:, list(at)] = values
    return made, scores


def held_at_once(cells: Cells | HeldCells) -> bool:
    return isinstance(cells, Cells) and cells.rows is not None and 0 < cells.rows <= HELD_CELLS
