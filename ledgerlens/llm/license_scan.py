"""License scan by ordered signature rules (operator 11).

A text is brought to lower-case words with single spaces. The keywords of the rules decide which rules are tried at all;
those whose expression matches mark their places, which become word positions. Overlaps are then settled by priority: a
place inside the place of a stronger rule (or of a wider one of the same kind) is dropped. Built-in functions alone: no Python
runs on the executors, and texts are never shuffled, only the places found in them.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import clean_texts, materialized
from ledgerlens.llm.license_rules import KINDS, RULES, Rule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks around a match; as control characters they never stand in a word.
OPEN, CLOSE = "\x02", "\x01"
PLACE = "array<struct<rule:int,start:int,stop:int>>"


def word_text(text: Column) -> Column:
    """Lower-case words, each with one space before it, and one space at the end; a single space without words."""
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _grouped(rules: Sequence[Rule]) -> Column:
    """The rules by keyword, as one constant."""
    groups = defaultdict(list)
    for number, rule in enumerate(rules):
        groups[rule.keyword].append({"number": number, "pattern": f" (?:{rule.pattern})(?= )"})
    rows = json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])
    return F.from_json(F.lit(rows), "array<struct<keyword:string,rules:array<struct<number:int,pattern:string>>>>")


def _places(words: Column, rule: Column) -> Column:
    """All matches of a rule as (rule, start, stop) in words from 0, stop exclusive."""
    marked = F.split(F.regexp_replace(words, rule["pattern"], F.lit(f"{OPEN}$0{CLOSE}")), F.lit(" "))
    at = lambda tokens, mark: F.filter(F.transform(tokens, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
    pairs = F.flatten(F.transform(F.array(marked), lambda tokens: F.arrays_zip(at(tokens, OPEN).alias("start"), at(tokens, CLOSE).alias("stop"))))
    return F.transform(pairs, lambda p: F.struct(rule["number"].alias("rule"), p["start"].alias("start"), p["stop"].alias("stop")))


def matches(words: Column, rules: Sequence[Rule]) -> Column:
    """Places of all rules in a word text. A keyword that a text lacks spares all its rules."""
    held = F.filter(_grouped(rules), lambda g: F.contains(words, g["keyword"]))
    tried = F.flatten(F.transform(held, lambda g: g["rules"]))
    hit = F.filter(tried, lambda r: F.rlike(words, r["pattern"]))
    return F.flatten(F.transform(hit, lambda r: _places(words, r))).cast(PLACE)


def surviving(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Places (row, rule, start, stop) that no stronger or wider place contains; base rules always survive.

    A running maximum of the ends of earlier starts, kept for each kind, tells whether a place is contained, so a text
    with very many places needs no comparison of pairs.
    """
    kinds = list(KINDS)
    numbers = F.lit([kinds.index(r.kind) for r in rules])
    places = found.where(F.size("places") > 0).select("row", F.inline("places")).withColumn("kind", F.get(numbers, F.col("rule")))
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("row", "kind").orderBy("start", F.desc("stop"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("kind") == k, F.col("stop"))).over(upto) for k in range(len(kinds) - 1)]
    placed = places.withColumns({f"reach_{k}": r for k, r in enumerate(reach)}).withColumn("same", F.max("stop").over(before))
    stronger = F.lit(False)
    for k in range(len(kinds) - 1):
        stronger = stronger | ((F.col("kind") > k) & F.coalesce(F.col(f"reach_{k}") >= F.col("stop"), F.lit(False)))
    inside = stronger | F.coalesce(F.col("same") >= F.col("stop"), F.lit(False))
    return placed.where((F.col("kind") == 0) | ~inside).select("row", "rule", "start", "stop")


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """License labels of every row of ``docs`` (doc_id, text), with the places they rest on.

    Words are runs of digits, letters and non-ASCII characters; A-Z is lower-cased and nothing else. ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` tell of the base phrases, which no other rule suppresses; ``labels`` holds the
    surviving rules' labels as well, ``score`` is the trust in the best of them (0 without any), ``places`` lists them by
    position. Null and empty texts have no words and no labels; very long texts are scanned whole. Repeated rows and rows
    without doc_id are returned each for itself. Rules of equal strength on the same words go by their order. An empty table
    gives an empty result; other columns of ``docs`` are not looked at.
    """
    rules = list(rules)
    base = sum(r.kind == "base" for r in rules)
    if any(r.kind == "base" for r in rules[base:]):
        raise ValueError("base rules come first")
    rows = clean_texts(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), word_text(F.col("text")).alias("words"))
    spaces = F.char_length("words") - F.char_length(F.replace("words", F.lit(" "), F.lit("")))
    found = materialized(rows.select("doc_id", "row", (spaces - 1).cast("long").alias("n_words"), matches(F.col("words"), rules).alias("places")), "license-places")
    labels, trust = F.lit([r.label for r in rules]), F.lit([KINDS[r.kind] for r in rules])
    kept = surviving(found, rules).select(
        "row", F.struct("start", "stop", F.get(labels, F.col("rule")).alias("label"), "rule").alias("place"), (F.col("rule") < base).alias("base"), F.get(trust, F.col("rule")).alias("trust")
    )
    label = F.col("place.label")
    settled = kept.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("place.start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("place.start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.max("trust").alias("score"),
        F.array_sort(F.collect_list("place")).alias("places"),
    )
    joined = found.select("doc_id", "row", "n_words").join(settled, "row", "left")
    blank = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "places": F.array().cast(settled.schema["places"].dataType)}
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", blank["n_base"]).alias("n_base"),
        "first_word",
        "last_word",
        *[F.coalesce(c, blank[c]).alias(c) for c in ("base_labels", "labels", "score", "places")],
    )

