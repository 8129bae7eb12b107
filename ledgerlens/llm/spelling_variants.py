"""Grouping of spelling variants by PartEnum signatures (operator 13).

The letters of a word are a multiset, and so a binary vector with a dimension for each (letter, occurrence). One replaced
letter moves two of its bits, one inserted or deleted letter moves one. Dimensions are dealt to a few parts; words of equal
length (distance at most two) agree on all but two parts, words whose lengths differ by one (distance one) on all but one
(Arasu, Ganti, Kaushik, 2006). Each choice of parts gives a signature: the letters in them. As an edit also leaves the first
or the second half of a word untouched, a signature is joined with either half, which keeps words apart that merely share
letters. Words meet in an equi-join on signatures and are then compared exactly, so no near pair is lost and none is added.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import clean_texts, materialized
from ledgerlens.session import spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAME_PARTS, OTHER_PARTS = 4, 2
#: What a signature row stands for: words of equal length, or the shorter or longer one of two lengths.
SAME, SHORT, LONG = 0, 1, 2


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, typo_every: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts, A-Z lower-cased, of ``min_length`` code points and ``min_count`` uses.

    With ``typo_every`` the CRC-32 h of ``<doc_id>:<run>`` decides on a made-up slip: if it is divisible, the code point
    h modulo length is left out. A missing doc_id is an empty number there.
    """
    runs = clean_texts(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if typo_every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        runs = runs.select("word", h.alias("h")).select(F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.char_length("word") >= min_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def letter_order(words: DataFrame) -> str:
    """All letters of the words, the most frequent first; the alphabet bounds its size."""
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    return "".join(r["letter"] for r in sorted(counts.collect(), key=lambda r: (-r["count"], r["letter"])))


def _parts(order: str, parts: int) -> Column:
    """The word's letters in order, each with how many of its occurrences are dealt to each part.

    Occurrence o of a letter goes to the part of its place in ``order`` plus o, so a projection is told by its counts.
    """
    letters = F.array_sort(F.array_distinct(F.split("word", "")))
    times = lambda c: F.char_length("word") - F.char_length(F.replace("word", c, F.lit("")))
    dealt = lambda c, part: F.floor((times(c) + F.pmod(F.instr(F.lit(order), c) - part, F.lit(parts))) / parts)
    return F.transform(letters, lambda c: F.struct(c.alias("c"), *[dealt(c, p).cast("int").alias(f"n{p}") for p in range(parts)]))


def _keys(kind: int, role: int, length: Column, letters: str, parts: int, left_out: int) -> list[Column]:
    """Signatures of one role: each choice of parts with either half, counted by the shorter word's ``length``."""
    half = F.floor(length / 2).cast("int")
    halves = [F.left("word", half), F.right("word", length - half)]
    found = []
    for number, chosen in enumerate(combinations(range(parts), parts - left_out)):
        counts = lambda x: F.struct(x["c"].alias("c"), sum((x[f"n{p}"] for p in chosen[1:]), x[f"n{chosen[0]}"]).alias("n"))  # noqa: B023, E731
        kept = F.filter(F.transform(letters, counts), lambda x: x["n"] > 0)
        for side, part in enumerate(halves):
            found.append(F.struct(F.xxhash64(F.lit(kind), length, F.lit(2 * number + side), part, kept).alias("key"), F.lit(role).cast("byte").alias("role")))
    return found


def signatures(words: DataFrame, order: str) -> DataFrame:
    """(key, role, word, n): all signature rows of every word."""
    placed = words.select("word", "n", _parts(order, SAME_PARTS).alias("four"), _parts(order, OTHER_PARTS).alias("two"))
    length = F.char_length("word")
    keys = F.array(
        *_keys(SAME, SAME, length, "four", SAME_PARTS, 2),
        *_keys(SHORT, SHORT, length, "two", OTHER_PARTS, 1),
        *_keys(SHORT, LONG, length - 1, "two", OTHER_PARTS, 1),
    )
    return placed.select(F.explode(keys).alias("s"), "word", "n").select("s.key", "s.role", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of words that one inserted, deleted or replaced letter tells apart, each pair once."""
    rows = signatures(spread(words, "word"), letter_order(words))
    left = rows.select("key", F.col("role").alias("a_role"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select("key", F.col("role").alias("b_role"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # one condition over both sides, so that both read the same shuffle
    roles = F.col("a_role") + F.col("b_role") * 3
    meet = ((roles == 0) & (F.col("a") < F.col("b"))) | (roles == SHORT + 3 * LONG)
    near = left.join(right, "key").where(meet & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "a_n", "b", "b_n").distinct()


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n; words are distinct).

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that is at least ``ratio`` times
    as frequent, else null; the root follows forms to the last one and is the word itself without one. Frequencies rise
    tenfold along a chain, so a few doublings reach every root.
    """
    words = materialized(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = pairs.select(F.explode(sides).alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("best_n"), F.col("best.near").alias("best"))
    chosen = F.col("best_n") >= F.col("n") * ratio
    found = materialized(found.select("word", "n", "n_near", F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "forms")
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("form_n")).first()[0]
    hops = max(1, math.ceil(math.log(most) / math.log(ratio))) if most else 0
    for _ in range(math.ceil(math.log2(hops + 1)) if hops else 0):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = materialized(steps.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, typo_every: int | None = None) -> DataFrame:
    """Frequent words of ``docs`` (doc_id, text), the form each is a variant of, and the root of its chain of forms.

    Null and empty texts hold no words; very long texts and very long words are taken whole. Repeated rows and rows without
    doc_id count like any other. Of near words with equal counts the smallest in code-point order is the form. An empty
    table gives an empty result; other columns of ``docs`` are not looked at, whatever their names.
    """
    return variant_groups(word_counts(docs, min_length, min_count, typo_every), ratio)
