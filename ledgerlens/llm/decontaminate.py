"""Benchmark decontamination: MinHash containment search partitioned by item size, verified exactly (operator 3).

Test items are partitioned by the power of two of their number of shingles. Each item keeps a bottom-k MinHash sketch: its
``SKETCH`` smallest shingle hashes. A document of any length is searched through its own shingles under the largest
sketched hash of any partition, so a short item inside a long document is not diluted as it is with one signature for the
whole document. Items with enough sketch hits are candidates, and candidates are verified over all their shingles.
Built-in functions alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized

WORDS = 5
CONTAINMENT = 0.8
SKETCH = 12
WORD_GAP = r"[^\p{L}\p{N}]+"


def shingle_rows(rows: DataFrame, key: Sequence[str], words: int = WORDS, shorter: Sequence[int] = ()) -> DataFrame:
    """(key, h): a hash for each shingle of ``words`` lower-cased words, repeats included, and of as many as in ``shorter``.

    Words are runs of letters and digits. A text of fewer words has one shingle, of all of them; one without words none.
    """
    terms = F.array_remove(F.split(F.lower("text"), WORD_GAP), "")
    hashed = rows.select(*key, F.transform(terms, lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    places = lambda n: F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    placed = hashed.select(*key, "w", F.explode(places(words)).alias("i"))
    rows = placed.select(*key, F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(words)]).alias("h"))
    for n in shorter:
        few = hashed.select(*key, "w", F.explode(places(n)).alias("i"))
        none = [F.lit(None).cast("long")] * (words - n)
        rows = rows.unionAll(few.select(*key, F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(n)], *none).alias("h")))
    return rows


def item_shingles(items: DataFrame, words: int = WORDS, sketch: int = SKETCH, containment: float = CONTAINMENT) -> DataFrame:
    """Distinct shingles of each item with its size, size partition, place in hash order, and sketch hits to ask for.

    An item whose shingles all fit into the sketch must show its full share there. Of a larger one, two hits of ``sketch``
    suffice: at a containment of 0.8 fewer are found with a chance below one in a million (12 draws).
    """
    named = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id"), F.col("text"))
    rows = shingle_rows(named, ["item_id"], words).distinct()
    own = Window.partitionBy("item_id")
    size = F.count(F.lit(1)).over(own)
    ranked = rows.select("item_id", "h", size.alias("n_shingles"), F.row_number().over(own.orderBy("h")).alias("place"))
    needed: Column = F.when(F.col("n_shingles") <= sketch, F.ceil(F.col("n_shingles") * containment - 1e-9)).otherwise(2)
    return ranked.withColumn("partition", F.floor(F.log2("n_shingles")).cast("int")).withColumn("needed", needed.cast("int"))


def short_lengths(items: DataFrame, words: int = WORDS) -> list[int]:
    """Numbers of words, below ``words``, that items have: such an item is one shingle of that length."""
    size = F.size(F.array_remove(F.split(F.lower("text"), WORD_GAP), ""))
    found = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(size.alias("n")).where(F.col("n").between(1, words - 1))
    return sorted(r["n"] for r in found.distinct().collect())


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, containment: float = CONTAINMENT, sketch: int = SKETCH, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(document, item) pairs of which the document holds at least ``containment`` of the item's distinct shingles.

    ``docs`` needs the columns of ``key`` and text, ``items`` item_id and text; other columns are not looked at. Items of
    fewer words than a shingle are one shingle of their own length, and are found anywhere in a document. Null or wordless
    texts and rows with a null in their key match nothing; an empty table gives an empty result. Very long texts are
    searched whole. Rows of equal key count as one document, as rows of equal item_id count as one item; ties do not occur, as every pair is judged by
    itself. Returns the key, item_id, n_shared, n_shingles, containment.
    """
    key = list(key)
    own = materialized(item_shingles(items, words, sketch, containment), "items")
    shorter = short_lengths(items, words)
    sketches = own.where(F.col("place") <= sketch)
    limits = sketches.groupBy("partition").agg(F.max("h").alias("limit"))
    limit = limits.agg(F.max("limit")).first()[0]
    if limit is None:
        limit = -(1 << 63)
    named = docs.where("text IS NOT NULL").select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in key], "text")
    texts = named.dropna(subset=key)
    probes = shingle_rows(texts, key, words, shorter).where(F.col("h") <= F.lit(limit))
    hits = probes.join(sketches.select("h", "item_id", "needed"), "h").groupBy(*key, "item_id", "needed").agg(F.count_distinct("h").alias("hits"))
    candidates = materialized(hits.where("hits >= needed").select(*key, "item_id"), "candidates")
    suspects = texts.join(candidates.select(*key).distinct(), key, "left_semi")
    found = shingle_rows(suspects, key, words, shorter).join(own.select("h", "item_id", "n_shingles"), "h")
    found = found.join(candidates, [*key, "item_id"], "left_semi")
    counts = found.groupBy(*key, "item_id", "n_shingles").agg(F.count_distinct("h").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    kept = counts.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment - 1e-9))
    return kept.select(*key, "item_id", "n_shared", "n_shingles", share.alias("containment"))
