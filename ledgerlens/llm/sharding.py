"""Contiguous shards of smallest largest size over ordered groups that stay whole (operator 8).

Groups (equal texts) are ordered by their first doc_id, and shards are contiguous runs of groups. The least capacity with
which the groups fit is found by searching over capacities; each is checked greedily: every shard takes groups up to the
capacity. A greedy step asks for the last group end at or below a number, or the next one. One Spark job answers that for many capacities
at once, over the prefix sums near the cuts alone, so the driver never sees more than a few numbers for each job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized, shuffle_parts

PROBES = 256

Steps = Callable[[list[int]], list[tuple[int, int]]]


def group_key(text: Column) -> Column:
    """What makes texts equal: SHA-256 of the UTF-8 bytes; a null text equals an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def running_totals(rows: DataFrame, order: list[str], totals: dict[str, str], label: str) -> DataFrame:
    """``rows`` with running sums in the given order (``totals``: result name to summed column), without a global window.

    Rows are range-partitioned and written with their range's number; sums of whole ranges (a row for each range) are
    added to running sums within ranges.
    """
    ranged = rows.repartitionByRange(shuffle_parts(rows), *order).withColumn("range_no", F.spark_partition_id())
    ranged = materialized(ranged, label)
    sums = ranged.groupBy("range_no").agg(*[F.sum(c).alias(f"{k}_all") for k, c in totals.items()])
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range_no", *[F.coalesce(F.sum(f"{k}_all").over(earlier), F.lit(0)).alias(f"{k}_before") for k in totals])
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(c).over(within).alias(f"{k}_in") for k, c in totals.items()]).join(before, "range_no")
    return summed.select(*rows.columns, *[(F.col(f"{k}_in") + F.col(f"{k}_before")).cast("long").alias(k) for k in totals])


def step_job(ends: DataFrame, largest: int) -> Steps:
    """For each number the last group end at or below it and the first one above, in one job over the ends near them.

    A group end lies within ``largest`` of any number up to the total, so ends farther off are filtered out; answers that
    no group end gives are 0.
    """

    def steps(numbers: list[int]) -> list[tuple[int, int]]:
        marks = sorted(set(numbers))
        near = ends.where((F.col("group_end") <= marks[-1] + largest) & (F.col("group_end") > marks[0] - largest))
        passed = F.size(F.filter(F.lit(marks), lambda mark: mark < F.col("group_end")))
        found = near.groupBy(passed.alias("passed")).agg(F.max("group_end").alias("last"), F.min("group_end").alias("next")).collect()
        last, after = {r["passed"]: r["last"] for r in found}, {r["passed"]: r["next"] for r in found}
        below, above, seen = {}, {}, 0
        for k, mark in enumerate(marks):
            below[mark] = seen = max(seen, last.get(k, 0))
        seen = 0
        for k in range(len(marks) - 1, -1, -1):
            above[marks[k]] = seen = after.get(k + 1, seen)
        return [(below[n], above[n]) for n in numbers]

    return steps


def best_cuts(steps: Steps, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the end of each shard when each takes groups up to it.

    A group larger than the capacity has a shard for itself. So one huge group does not raise the capacity of the other
    shards, and the largest shard is still as small as it can be.
    """
    share = -(-total // shards)
    low, high = (share if largest <= share else 1), largest + share  # the upper one always suffices
    ends: dict[int, list[int]] = {}

    def check(capacities: list[int]) -> None:
        at = dict.fromkeys(capacities, 0)
        cuts: dict[int, list[int]] = {c: [] for c in capacities}
        for _ in range(shards):
            open_ = [c for c in capacities if at[c] < total]
            if open_:
                for c, (last, after) in zip(open_, steps([at[c] + c for c in open_]), strict=True):
                    at[c] = last if last > at[c] else after
            for c in capacities:
                cuts[c].append(at[c])
        ends.update(cuts)

    while True:
        step = max(1, -(-(high - low) // PROBES))
        probes = sorted({*range(low, high, step), high})
        check(probes)
        best = next(c for c in probes if ends[c][-1] >= total)
        if step == 1 or best == low:
            return best, ends[best]
        low, high = max(low, best - step + 1), best


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Assign every document to one of ``shards`` contiguous shards; equal texts stay together.

    Size is the text's UTF-8 bytes plus 1 (null: 1). The largest shard is as small as whole, ordered groups allow; a group
    larger than the capacity of the others has a shard for itself. Groups are ordered by their first doc_id; slots
    within a shard follow doc_id, then the text's digest. Repeated rows get slots of their own. An empty table gives an
    empty result; a null doc_id sorts first, and groups of equal first doc_id by digest. Very long texts count like any other;
    other columns of ``docs`` are not looked at, whatever their names. Returns doc_id, size, text_crc32, shard, slot.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"),
        group_key(F.col("text")).alias("group_key"),
    )
    base = materialized(base, "shard-rows")
    groups = base.groupBy("group_key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    ends = materialized(running_totals(groups, ["first", "group_key"], {"group_end": "bytes"}, "shard-groups"), "shard-ends")
    total, largest = ends.agg(F.max("group_end"), F.max("bytes")).first()
    if total is None:
        cuts = [0] * shards
    else:
        _, cuts = best_cuts(step_job(ends.select("group_end").persist(), largest), total, largest, shards)
    shard = F.size(F.filter(F.lit(cuts), lambda cut: cut < F.col("group_end")))
    placed = base.join(ends.select("group_key", shard.cast("int").alias("shard")), "group_key")
    flags = {f"before_{s}": (F.col("shard") == s).cast("long") for s in range(shards)}
    counted = running_totals(placed.withColumns(flags), ["doc_id", "group_key"], {f"upto_{s}": f"before_{s}" for s in range(shards)}, "shard-slots")
    slot = F.element_at(F.array(*[F.col(f"upto_{s}") for s in range(shards)]), F.col("shard") + 1) - 1
    return counted.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
