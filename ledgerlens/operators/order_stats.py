"""Exact order statistics and positions without a single-task sort.

``percentile`` keeps one counter per distinct value in a single final task. That is right while the number of distinct
values is known to be small, so it is measured first; beyond the limit the wanted ranks are found by narrowing
intervals with approximate sketches and exact counts. Positions and running sums are computed per range of rows, with
the totals of the earlier ranges added. Limits on rows choose a plan, never a result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import materialized

DIRECT_ROWS = 1_000_000
DIRECT_DISTINCT = 10_000
COLLECT_ROWS = 50_000
ROWS_PER_TASK = 1_000_000
SKETCH_ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence[float]],
    rows: int | None = None,
    direct_rows: int = DIRECT_ROWS,
    direct_distinct: int = DIRECT_DISTINCT,
    collect_rows: int = COLLECT_ROWS,
    approx: bool = False,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns, nulls ignored, as plain numbers on the driver.

    The result has ``len(columns) x len(probabilities)`` numbers, so callers put them into plans as literals. ``rows``,
    when the caller has counted them, saves the pass that measures sizes. ``percentile`` is used up to ``direct_rows``
    values or ``direct_distinct`` distinct ones.
    """
    columns = list(probabilities)
    if not columns:
        return {}
    if approx:
        row = df.agg(
            *[
                F.percentile_approx(F.col(c).cast("double"), list(map(float, probabilities[c])), SKETCH_ACCURACY).alias(f"q{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {c: list(row[f"q{i}"] or [None] * len(probabilities[c])) for i, c in enumerate(columns)}

    sizes: dict[str, int] = {}
    direct = columns
    if rows is None or rows > direct_rows:
        row = df.agg(
            *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
            *[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)],
        ).first()
        sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
        direct = [c for i, c in enumerate(columns) if sizes[c] <= direct_rows or row[f"d{i}"] <= direct_distinct]
    found: dict[str, list[float | None]] = {}
    if direct:
        row = df.agg(
            *[
                F.percentile(F.col(c).cast("double"), [float(p) for p in probabilities[c]]).alias(f"q{i}")
                for i, c in enumerate(direct)
            ]
        ).first()
        for i, c in enumerate(direct):
            found[c] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probabilities[c])
    rest = [c for c in columns if c not in found]
    if rest:
        positions = {c: [(sizes[c] - 1) * float(p) for p in probabilities[c]] for c in rest}
        ranks = {c: sorted({int(f(h)) for h in positions[c] for f in (math.floor, math.ceil)}) for c in rest}
        at = _selected(df, ranks, sizes, collect_rows)
        for c in rest:
            found[c] = []
            for h in positions[c]:
                low, high = float(at[c][math.floor(h)]), float(at[c][math.ceil(h)])
                found[c].append(low + (high - low) * (h - math.floor(h)))
    return found


def values_at_ranks(
    df: DataFrame, column: str, ranks: Sequence[int], n: int | None = None, collect_rows: int = COLLECT_ROWS
) -> dict[int, float]:
    """The values at 0-based ``ranks`` of a numeric column in ascending order, nulls ignored."""
    if n is None:
        n = df.agg(F.count(F.col(column)).alias("n")).first()["n"]
    return _selected(df, {column: list(ranks)}, {column: n}, collect_rows)[column]


@dataclass
class _Interval:
    """Open interval of a column that still holds wanted ranks; ``below`` rows lie under it, ``size`` within."""

    column: str
    low: float | None
    high: float | None
    below: int
    size: int
    wanted: list[int]

    def inside(self) -> Column:
        return _strictly_between(F.col(self.column), self.low, self.high)


def _selected(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], sizes: Mapping[str, int], collect_rows: int
) -> dict[str, dict[int, float]]:
    """Exact selection for several columns at once.

    Each interval is cut at sketch estimates; exact counts decide on which side a rank lies, so the sketch affects speed
    only. An interval is listed once it holds ``collect_rows`` rows or fewer. Values carried by very many rows are hit by
    the estimates and settle at once. Three passes over the columns do for tens of millions of rows, two more
    for each further factor of a thousand.
    """
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    pending = [_Interval(c, None, None, 0, sizes[c], sorted(set(r))) for c, r in ranks.items() if r]
    while pending:
        small = [p for p in pending if p.size <= collect_rows]
        pending = [p for p in pending if p.size > collect_rows]
        if small:
            _list_small(df, small, found)
        if pending:
            pending = _narrowed(df, pending, found)
    return found


def _list_small(df: DataFrame, intervals: Sequence[_Interval], found: dict[str, dict[int, float]]) -> None:
    """Settle intervals of ``COLLECT_ROWS`` rows at most: their distinct values are counted and added up in order, and the
    values at the wanted ranks alone come to the driver."""
    cells = [F.when(p.inside(), F.struct(F.lit(i).alias("i"), F.col(p.column).cast("double").alias("v"))) for i, p in enumerate(intervals)]
    listed = df.select(F.explode(F.array(*cells)).alias("e")).filter(F.col("e").isNotNull())
    counted = listed.groupBy(F.col("e.i").alias("i"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = F.element_at(F.array(*[F.array(*[F.lit(r - p.below) for r in p.wanted]) for p in intervals]), F.col("i") + 1)
    hits = counted.withColumn("upto", upto).select("i", "v", F.filter(wanted, lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto"))).alias("ranks"))
    for r in hits.filter(F.size("ranks") > 0).collect():
        p = intervals[r["i"]]
        found[p.column].update({p.below + rank: r["v"] for rank in r["ranks"]})


def _narrowed(df: DataFrame, intervals: Sequence[_Interval], found: dict[str, dict[int, float]]) -> list[_Interval]:
    slack = 3.0 / SKETCH_ACCURACY
    cuts = []
    for i, p in enumerate(intervals):
        shares = [(r - p.below + 0.5) / p.size for r in p.wanted]
        asked = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)})
        cuts.append(F.percentile_approx(F.when(p.inside(), F.col(p.column).cast("double")), asked, SKETCH_ACCURACY).alias(f"a{i}"))
    estimates = df.agg(*cuts).first()
    points = [sorted(set(estimates[f"a{i}"])) for i in range(len(intervals))]
    counts = []
    for i, p in enumerate(intervals):
        value = F.col(p.column)
        for j, point in enumerate(points[i]):
            counts.append(F.count_if(p.inside() & (value < F.lit(point))).alias(f"l{i}_{j}"))
            counts.append(F.count_if(p.inside() & (value == F.lit(point))).alias(f"e{i}_{j}"))
    exact = df.agg(*counts).first()

    following = []
    for i, p in enumerate(intervals):
        pieces = []  # (low, high, from row, to row); low == high for a single value
        left, start = p.low, 0
        for j, point in enumerate(points[i]):
            less, equal = exact[f"l{i}_{j}"], exact[f"e{i}_{j}"]
            pieces += [(left, point, start, less), (point, point, less, less + equal)]
            left, start = point, less + equal
        pieces.append((left, p.high, start, p.size))
        for low, high, first, last in pieces:
            here = [r for r in p.wanted if first <= r - p.below < last]
            if here and low is not None and low == high:
                found[p.column].update({r: low for r in here})
            elif here:
                following.append(_Interval(p.column, low, high, p.below + first, last - first, here))
    return following


def _strictly_between(value: Column, low, high) -> Column:
    condition = value.isNotNull()
    if low is not None:
        condition = condition & (value > F.lit(low))
    if high is not None:
        condition = condition & (value < F.lit(high))
    return condition


def _ordering(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order]


def _ranged(df: DataFrame, order: Sequence[tuple[str, bool]], by: Sequence[str], n: int, rows_per_task: int) -> DataFrame:
    """``df`` in ascending ranges of (by, order), written with the number of each row's range as ``_range``.

    Ranges are cut by sampled rows of all these columns in their own types, so neither a common value nor the nulls of
    one column share a task, as long as the last column tells rows apart.
    """
    parts = max(2, math.ceil(2 * n / rows_per_task), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in by], *_ordering(order))
    return materialized(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def with_position(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    name: str = "position",
    by: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """1-based position of every row under ``order`` (column, descending?), overall or within ``by``; nulls come last.

    The last order column must be unique (within ``by``). Columns are compared in their own types. ``rows_per_task``
    changes the plan alone. Give a persisted frame: it is read more than once.
    """
    n = df.count()
    by = list(by)
    if n <= rows_per_task:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*_ordering(order))).cast("long"))
    ranged = _ranged(df, order, by, n, rows_per_task)
    keys = [*by, "_range"]
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_ordering(order))))
    joined = _null_safe_join(placed, offsets, keys)
    return joined.withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).drop("_range", "_offset")


def with_running_sum(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add running sums ``{source column: new column}`` under ``order``; rows up to and including the current one."""
    n = df.count()
    by = list(by)
    if n <= rows_per_task:
        upto = Window.partitionBy(*by).orderBy(*_ordering(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({new: F.sum(old).over(upto) for old, new in sums.items()})
    ranged = _ranged(df, order, by, n, rows_per_task)
    keys = [*by, "_range"]
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys).agg(*[F.sum(old).alias(f"_t_{new}") for old, new in sums.items()])
    offsets = offsets.withColumns(
        {f"_o_{new}": F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)) for new in sums.values()}
    ).select(*keys, *[f"_o_{new}" for new in sums.values()])
    upto = Window.partitionBy(*keys).orderBy(*_ordering(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({new: F.sum(old).over(upto) for old, new in sums.items()})
    joined = _null_safe_join(placed, offsets, keys)
    kinds = {new: placed.schema[new].dataType for new in sums.values()}
    joined = joined.withColumns({new: _added(F.col(new), F.col(f"_o_{new}"), kind) for new, kind in kinds.items()})
    return joined.drop("_range", *[f"_o_{new}" for new in sums.values()])


def _added(a: Column, b: Column, kind: T.DataType) -> Column:
    """The sum in the type of both. Decimals of full precision give up a leading digit, so that no last one is lost."""
    if isinstance(kind, T.DecimalType) and kind.precision == 38:
        shorter = T.DecimalType(37, kind.scale)
        return (a.cast(shorter) + b.cast(shorter)).cast(kind)
    return (a + b).cast(kind)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition).drop(*[f"_k_{k}" for k in keys])


def top_share(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    share: float,
    by: Sequence[str] = (),
    rounding: str = "int",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The best ``share`` of all rows (``rounding='int'`` truncates, ``'even'`` rounds half to even) or of each group."""
    by = list(by)
    placed = with_position(df, order, "_position", by, rows_per_task)
    quota = F.col("_size") * F.lit(float(share))
    quota = F.floor(quota) if rounding == "int" else F.bround(quota)
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        placed = _null_safe_join(placed, sizes, by)
    else:
        placed = placed.withColumn("_size", F.lit(df.count()))
    return placed.filter(F.col("_position") <= quota).drop("_position", "_size")
