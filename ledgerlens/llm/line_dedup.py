"""Removal of repeated runs of lines by overlapping three-line windows (operator 6).

Each window of consecutive lines is hashed; the first place of every window that occurs more than once is found by one
aggregation with map-side combine; all other places cover their lines, and covered lines are merged and removed. Built-in
functions alone: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized

WIDTH = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(key, doc_id, twin, at, w1, w2): a 128-bit hash for each window of lines that is not blank throughout."""
    lines = F.split("text", "\n")
    first = docs.select("doc_id", "twin", F.transform(lines, lambda x: F.xxhash64(x)).alias("a"), F.transform(lines, lambda x: F.xxhash64(F.lit(1), x)).alias("b"), F.transform(lines, lambda x: F.trim(x) != "").alias("solid"))
    placed = first.where(F.size("a") >= width).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("a") - (width - 1))))
    part = lambda c: [F.element_at(c, F.col("at") + k) for k in range(width)]
    some = part("solid")[0]
    for x in part("solid")[1:]:
        some = some | x
    return placed.where(some).select("doc_id", "twin", "at", F.xxhash64(*part("a")).alias("w1"), F.xxhash64(*part("b")).alias("w2"))


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Places of windows that stand elsewhere first: (doc_id, twin, at), at counted from 1."""
    places = materialized(_windows(docs, width), "line-windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "twin", "at")
    firsts = places.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2", "first")
    same_doc = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("twin") == F.col("first.twin"))
    own = same_doc & (F.col("at") < F.col("first.at") + width)  # the first place, and what overlaps it
    return places.join(firsts, ["w1", "w2"]).where(~own).select("doc_id", "twin", "at")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("twin", F.xxhash64(text))


def edited_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, text, n_lines, n_removed): each row of ``docs`` as a struct, its text without repeated lines, and counts."""
    slim = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    covered = repeated_windows(_keyed(slim), width).groupBy("doc_id", "twin").agg(F.collect_set("at").alias("at"))
    gone = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + (width - 1)))))
    hits = covered.select("doc_id", "twin", gone.alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc.text")
    joined = rows.join(hits, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("twin")), "left")
    lines = F.split(text, "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("gone")), lambda i: F.element_at(lines, i)), "\n")
    return joined.select(
        "doc",
        F.when(F.col("gone").isNotNull(), left).otherwise(text).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def remove_repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Take every run of ``width`` lines that stands earlier in the table (by doc_id, then line) out of its later places.

    Lines end at line feeds and are compared byte for byte. Windows of blank lines alone are not counted, nor is a place
    that overlaps the window's first place in the same document, so a run of equal lines keeps its first ``width``.
    Texts of fewer lines stay whole, very long ones are read whole. Of repeated rows (equal doc_id and text) all count as one document and get the same
    result. Null texts stay null and have 0 lines; documents without doc_id come first in the order. Every row and column
    of ``docs`` is kept, ``text`` changed; ``n_lines`` and ``n_removed`` are added (columns of these names are replaced).
    """
    own = [F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return edited_lines(docs, width).select(*own, "n_lines", "n_removed")
