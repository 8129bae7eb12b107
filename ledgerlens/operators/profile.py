"""Table profiling: every report is one or two aggregates over the table, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.order_stats import quantiles
from ledgerlens.session import kept

PROFILE_QUANTILES = (0, 0.05, 0.50, 0.95, 0.99, 1)
SUMMARY_QUANTILES = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.StringType, T.VarcharType, T.CharType))


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_number(df, c)]


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def long_report(aggregated: DataFrame, entries: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Turn one aggregated row into rows ``(column, metric, value)``."""
    rows = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for c, m, v in entries]
    return aggregated.select(F.inline(F.array(*rows)))


def _present(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def _one_row(df: DataFrame, figures: Sequence[Column]) -> DataFrame:
    """The figures of one aggregate, computed now, so that what follows reads no input."""
    found = df.agg(*figures)
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def table_profile(df: DataFrame, probabilities: Sequence[float] = PROFILE_QUANTILES) -> DataFrame:
    """Rows and columns, nulls of every column, and quantiles of the numeric ones, as ``(column, metric, value)``."""
    numbers = numeric_columns(df)
    with kept(df) as rows:
        counted = _one_row(rows, [F.count(F.lit(1)).alias("_rows"), *[F.count_if(~_present(df, c)).alias(f"n_{i}") for i, c in enumerate(df.columns)]])
        found = quantiles(rows, {c: probabilities for c in numbers}, rows=counted.first()["_rows"])
    entries = [("*", "rows", F.col("_rows")), ("*", "columns", F.lit(len(df.columns)))]
    entries += [(c, "nulls", F.col(f"n_{i}")) for i, c in enumerate(df.columns)]
    entries += [(c, f"q{p:g}", F.lit(v)) for c in numbers for p, v in zip(probabilities, found[c])]
    return long_report(counted, entries)


def ends(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first and last ``n`` rows by a unique ``key``, marked ``head`` or ``tail`` in ``part``: two top-k selections."""
    head = df.orderBy(F.col(key).asc_nulls_last()).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.col(key).desc_nulls_first()).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def null_counts(df: DataFrame, with_type: bool = False) -> DataFrame:
    """Nulls and present values per column: ``(column, nulls, present)``, and its type by Spark's short name if asked."""
    counted = df.agg(*[F.count_if(~_present(df, c)).alias(f"n_{i}") for i, c in enumerate(df.columns)], F.count(F.lit(1)).alias("_rows"))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n_{i}").alias("nulls"),
            (F.col("_rows") - F.col(f"n_{i}")).alias("present"),
            *([F.lit(kind).alias("type")] if with_type else []),
        )
        for i, (c, kind) in enumerate(df.dtypes)
    ]
    return counted.select(F.inline(F.array(*rows)))


def numeric_summary(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = SUMMARY_QUANTILES) -> DataFrame:
    """Count, mean, sample deviation, minimum, quantiles and maximum as ``(column, metric, value)``."""
    with kept(df.select(*columns)) as rows:
        measured = _one_row(rows, [f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in _BASIC.items()])
        most = max((measured.first()[f"count_{i}"] for i in range(len(columns))), default=0)
        found = quantiles(rows, {c: probabilities for c in columns}, rows=most)
    entries = [(c, n, F.col(f"{n}_{i}")) for i, c in enumerate(columns) for n in _BASIC]
    entries += [(c, f"{p * 100:g}%", F.lit(v)) for c in columns for p, v in zip(probabilities, found[c])]
    return long_report(measured, entries)


_BASIC = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def frequency_table(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of the values of one column, or of the pairs of two; nulls left out."""
    kept = df.select(*columns).na.drop("any")
    return kept.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per column and row: ``(keep..., column, value)`` with values as text."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def category_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percentage (of all rows, nulls included) of each value of each column."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counted = long_values(df, columns).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("ratio", F.lit(100.0) * F.col("count") / total)


@dataclass
class ColumnGroups:
    """Columns by kind. ``number_as_category`` is contained in ``category``."""

    category: list[str] = field(default_factory=list)
    number: list[str] = field(default_factory=list)
    high_cardinality: list[str] = field(default_factory=list)
    number_as_category: list[str] = field(default_factory=list)


def column_groups(df: DataFrame, category_below: int = 10, cardinal_above: int = 20) -> ColumnGroups:
    """Sort columns by type and number of distinct values (nulls not counted).

    Text with more than ``cardinal_above`` values is high-cardinality, other text categorical; a non-text column with
    fewer than ``category_below`` values counts as categorical too.
    """
    counts = few_distinct(df, max(category_below, cardinal_above))
    groups = ColumnGroups()
    for c in df.columns:
        if is_text(df, c):
            (groups.high_cardinality if counts[c] is None or counts[c] > cardinal_above else groups.category).append(c)
        elif counts[c] is not None and counts[c] < category_below:
            groups.number_as_category.append(c)
        else:
            groups.number.append(c)
    groups.category = groups.category + groups.number_as_category
    return groups


def distinct_counts(df: DataFrame, approx: bool = False) -> dict[str, int]:
    """Distinct values per column, nulls left out: exact, or all of them from a sketch if ``approx``."""
    count = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[count(F.col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[f"d{i}"] for i, c in enumerate(df.columns)}


def few_distinct(df: DataFrame, limit: int) -> dict[str, int | None]:
    """Distinct values per column, or None where there are more than ``limit``.

    A sketch that finds over twenty times the limit settles a column; the others are counted exactly, which shuffles
    little, as they have few values.
    """
    sketch = distinct_counts(df, approx=True)
    small = [c for c in df.columns if sketch[c] <= 20 * limit]
    exact = distinct_counts(df.select(*small)) if small else {}
    return {c: exact[c] if c in exact and exact[c] <= limit else None for c in df.columns}


def target_by_category(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Mean target per value of each column."""
    pairs = long_values(df, columns, [target]).filter(F.col("value").isNotNull())
    return pairs.groupBy("column", "value").agg(F.avg(target).alias("target_mean"))


def numbers_by_target(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each numeric column per target value, one column each."""
    return df.filter(F.col(target).isNotNull()).groupBy(target).agg(*[F.avg(c).alias(c) for c in columns])


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over rows where both are present; null with fewer than two rows or no spread."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(F.count_if(both) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix, ``(column_a, column_b, corr)`` with a before b; one aggregate."""
    pairs = list(combinations(columns, 2))
    measured = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return measured.select(F.inline(F.array(*rows)))


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.90) -> DataFrame:
    """Columns correlated (in absolute value) above the threshold with an earlier column."""
    return correlations(df, columns).filter(F.abs("corr") > threshold).select(F.col("column_b").alias("column")).distinct()


def service_agreement(df: DataFrame, columns: Sequence[str], yes: str = "Yes", no: str = "No") -> DataFrame:
    """For every pair of columns: percentage of rows both yes or both no, and percentage that differ."""
    pairs = list(combinations(columns, 2))
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, (a, b) in enumerate(pairs):
        both = ((F.col(a) == yes) & (F.col(b) == yes)) | ((F.col(a) == no) & (F.col(b) == no))
        aggregates.append(F.count_if(both).alias(f"s{i}"))
        # a missing value differs from everything, also from another missing value
        aggregates.append(F.count_if(F.coalesce(F.col(a) != F.col(b), F.lit(True))).alias(f"d{i}"))
    counted = df.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(f"{a} vs. {b}").alias("pair"),
            (F.try_divide(F.col(f"s{i}"), F.col("_rows")) * 100).alias("same"),
            (F.try_divide(F.col(f"d{i}"), F.col("_rows")) * 100).alias("different"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return counted.select(F.inline(F.array(*rows)))


def values_where(df: DataFrame, column: str, equals: str, columns: Sequence[str]) -> DataFrame:
    """Value counts of ``columns`` among the rows where ``column`` has the given value."""
    pairs = long_values(df.filter(F.col(column) == equals), columns).filter(F.col("value").isNotNull())
    return pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def rare_report(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Count, share of all rows and mean target per value of each column."""
    total = df.agg(F.count(F.lit(1))).scalar()
    pairs = long_values(df, columns, [target]).filter(F.col("value").isNotNull())
    counted = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"), F.avg(target).alias("target_mean"))
    return counted.withColumn("ratio", F.col("count") / total)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal intervals over the observed range; the maximum falls in the last. Empty bins are left out."""
    limits = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")).first()
    low, high = limits["low"], limits["high"]
    value = F.col(column).cast("double")
    if low is None:
        return df.limit(0).select(F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("count"))
    if low == high:
        low, high = low - 0.5, high + 0.5
    number = F.least(F.lit(bins - 1), F.floor((value - F.lit(low)) * F.lit(bins) / F.lit(high - low)))
    counted = df.filter(value.isNotNull()).groupBy(number.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (high - low) / bins
    return counted.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "count")


def box_plot(df: DataFrame, columns: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 box lengths) and the number of points beyond."""
    found = quantiles(df, {c: (0.25, 0.5, 0.75) for c in columns})
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        q1, q2, q3 = found[c]
        value = F.col(c).cast("double")
        if q1 is None:
            inside = F.lit(False)
        else:
            reach = whisker * (q3 - q1)
            inside = (value >= F.lit(q1 - reach)) & (value <= F.lit(q3 + reach))
        aggregates += [
            F.min(F.when(inside, value)).alias(f"a{i}"),
            F.max(F.when(inside, value)).alias(f"b{i}"),
            F.count_if(value.isNotNull() & ~inside).alias(f"o{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"a{i}").alias("low"), F.lit(q1).cast("double").alias("q1"), F.lit(q2).cast("double").alias("median"),
                F.lit(q3).cast("double").alias("q3"), F.col(f"b{i}").alias("high"), F.col(f"o{i}").alias("beyond"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def regression_line(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """Least-squares line of each ``y`` on ``x``: ``(column, slope, intercept)``."""
    a = F.col(x).cast("double")
    aggregates = []
    for i, y in enumerate(ys):
        b = F.col(y).cast("double")
        both = a.isNotNull() & b.isNotNull()
        px, py = F.when(both, a), F.when(both, b)
        aggregates.append(F.try_divide(F.covar_pop(px, py), F.nullif(F.var_pop(px), F.lit(0.0))).alias(f"s{i}"))
        aggregates.append(F.avg(px).alias(f"x{i}"))
        aggregates.append(F.avg(py).alias(f"y{i}"))
    rows = [
        F.struct(F.lit(y).alias("column"), F.col(f"s{i}").alias("slope"), (F.col(f"y{i}") - F.col(f"s{i}") * F.col(f"x{i}")).alias("intercept"))
        for i, y in enumerate(ys)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def transposed(row: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Key-value view ``(column, value)`` of the few rows given."""
    return long_values(row, columns or row.columns)
