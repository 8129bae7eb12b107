"""k-means and k-modes, and the cost sweeps used to choose the number of clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import reused


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, features: str = "features") -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)


def kmeans_costs(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(1, 20), seed: int = 42) -> list[tuple[int, float]]:
    """Sum of squared distances to the nearest centre for each ``k``: the least one for a single column, else what k-means finds."""
    exact = exact_costs(df, columns[0], max(ks)) if len(columns) == 1 else None
    if exact is not None:
        return [(k, c) for k, c in exact if k in ks]
    rows = reused(with_vector(df, columns))
    costs = []
    for k in ks:
        if k == 1:
            spread = rows.agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in columns]).first()
            costs.append((1, float(sum(spread))))
        else:
            costs.append((k, float(fit_kmeans(rows, k, seed).summary.trainingCost)))
    rows.unpersist()
    return costs


#: Distinct values of a column up to which its best clusters are found exactly.
EXACT_VALUES = 1_000_000


def exact_costs(df: DataFrame, column: str, most: int = 19) -> list[tuple[int, float]] | None:
    """The least possible sum of squared distances to centres of one column, for 1 to ``most`` clusters (no more
    than there are distinct values); nulls left out.

    In one dimension clusters are runs of the sorted values, so equal values are counted first and the best runs are found
    by dynamic programming over what is left: as the last run's start never falls while its end rises, each number of
    clusters takes about log2(m) vectorised passes over m distinct values. None beyond ``EXACT_VALUES`` of them.
    """
    counts = reused(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    m = counts.count()
    if m > EXACT_VALUES:
        counts.unpersist()
        return None
    table = counts.toArrow()
    counts.unpersist()
    if not m:
        return []
    v, n = table.column("v").to_numpy(), table.column("n").to_numpy().astype(float)
    order = np.argsort(v)
    v, n = v[order] - np.average(v, weights=n), n[order]
    upto = [np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * v, n * v * v)]

    def cost(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        rows, total, square = (u[high + 1] - u[low] for u in upto)
        return np.maximum(square - total * total / rows, 0.0)

    best = cost(np.zeros(m, np.int64), np.arange(m))
    found = [(1, float(best[-1]))]
    for k in range(2, min(most, m) + 1):
        best = _next_layer(best, cost, m)
        found.append((k, float(best[-1])))
    return found


def _next_layer(before: np.ndarray, cost: Callable[[np.ndarray, np.ndarray], np.ndarray], m: int) -> np.ndarray:
    """For each end the least of ``before[start - 1] + cost(start, end)`` over starts: middles first, between known starts."""
    best, start = before.copy(), np.zeros(m, np.int64)
    known = np.array([-1, m])  # ends whose best start is settled; the bounds stand for 1 and their own place
    while len(known) < m + 2:
        low, high = known[:-1], known[1:]
        open_ = high - low > 1
        low, high = low[open_], high[open_]
        middle = (low + high) // 2
        first = np.where(low < 0, 1, np.maximum(start[np.maximum(low, 0)], 1))
        last = np.where(high == m, middle, np.minimum(start[np.minimum(high, m - 1)], middle))
        last, real = np.maximum(last, first), middle >= first
        size = last - first + 1
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        end = np.repeat(middle, size)
        value = np.where(at <= end, before[np.maximum(at - 1, 0)] + cost(np.minimum(at, end), end), np.inf)
        edges = np.cumsum(size) - size
        least = np.minimum.reduceat(value, edges)
        hit = np.flatnonzero(value == np.repeat(least, size))
        pick = at[hit[np.searchsorted(hit, edges)]]
        # an end with fewer values before it than runs keeps what fewer runs cost
        better = real & (least <= before[middle])
        best[middle] = np.where(better, least, before[middle])
        start[middle] = np.where(real, pick, first)
        known = np.sort(np.concatenate([known, middle]))
    return best


def knee(costs: Sequence[tuple[int, float]]) -> int:
    """The ``k`` furthest below the line from the first to the last cost."""
    (k0, c0), (k1, c1) = costs[0], costs[-1]
    drop = [(c0 + (c1 - c0) * (k - k0) / max(1, k1 - k0)) - c for k, c in costs]
    return costs[drop.index(max(drop))][0]


def mismatches(columns: Sequence[str], mode: Sequence) -> Column:
    """Number of columns that differ from the mode; null matches null."""
    total = F.lit(0)
    for c, m in zip(columns, mode):
        total = total + (~F.col(c).eqNullSafe(F.lit(m))).cast("int")
    return total


def nearest_mode(columns: Sequence[str], modes: Sequence[Sequence]) -> Column:
    """0-based cluster with the fewest mismatches; the first of equals."""
    distances = F.array(*[mismatches(columns, m) for m in modes])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def fit_kmodes(df: DataFrame, columns: Sequence[str], k: int, starts: int = 5, seed: int = 42, steps: int = 50) -> tuple[list[tuple], int]:
    """Best modes and their cost (total mismatches) over several random starts.

    Rows are collapsed to distinct combinations with counts, and all starts advance together: one small aggregate per
    step, from which only (start, cluster, column) modes come back.
    """
    columns = list(columns)
    combos = reused(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    runs: list[list[tuple]] = []
    for start in range(starts):
        picked = combos.orderBy(F.xxhash64(*columns, F.lit(seed + start)), *columns).limit(k).collect()
        runs.append([tuple(r[c] for c in columns) for r in picked])
    best: dict[int, tuple[int, list[tuple]]] = {}
    active = set(range(starts))
    for _ in range(steps):
        if not active:
            break
        turn = sorted(active)
        assigned = combos.withColumn(
            "_runs",
            F.array(*[F.struct(F.lit(r).alias("run"), nearest_mode(columns, runs[r]).alias("cluster")) for r in turn]),
        )
        cells = assigned.select(
            "_n",
            F.inline("_runs"),
            *columns,
        ).select("_n", "run", "cluster", F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("column", "value"))
        counted = cells.groupBy("run", "cluster", "column", "value").agg(F.sum("_n").alias("n"))
        top = counted.groupBy("run", "cluster", "column").agg(
            F.max_by("value", F.struct("n", "value")).alias("mode"), F.max("n").alias("hits"), F.sum("n").alias("total")
        )
        found = top.collect()
        for r in turn:
            mine = [x for x in found if x["run"] == r]
            cost = sum(x["total"] - x["hits"] for x in mine)
            modes = [list(m) for m in runs[r]]
            for x in mine:
                modes[x["cluster"]][x["column"]] = x["mode"]
            modes = [tuple(m) for m in modes]
            if r in best and cost >= best[r][0]:
                active.discard(r)
            else:
                best[r] = (cost, modes)
                runs[r] = modes
    combos.unpersist()
    if active:
        raise ArithmeticError(f"the modes still improve after {steps} steps")
    cost, modes = min(best.values(), key=lambda x: x[0])
    return modes, int(cost)


def kmodes_clusters(df: DataFrame, columns: Sequence[str], k: int, starts: int = 5, seed: int = 42, name: str = "cluster") -> DataFrame:
    """Text columns only; adds the cluster number."""
    modes, _ = fit_kmodes(df, columns, k, starts, seed)
    return df.withColumn(name, nearest_mode(columns, modes))


def kmodes_costs(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(1, 10), starts: int = 5, seed: int = 42) -> list[tuple[int, int]]:
    return [(k, fit_kmodes(df, columns, k, starts, seed)[1]) for k in ks]
