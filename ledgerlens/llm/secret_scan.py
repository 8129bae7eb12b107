"""Secret scan with linking of credential parts (operator 5).

A first pass finds the strong spans of three kinds and weak candidates (bare 40-character keys, endpoints) that would be
noise alone. Parts of a document are then interval-joined: a weak candidate is reported only where its complementary parts
lie within the same scope, a distance in characters. The join is an equi-join on cells of the scope's width, so a part
meets its neighbours alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import clean_texts, materialized, slices

KINDS = ("assign", "access", "hex", "key", "endpoint")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SCOPE = 200


def find_parts(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of strong spans and weak candidates, in code points, end exclusive."""
    found = []
    for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE):
        if m.end(2) - m.start(2) >= 6:
            found.append((0, m.start(), m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            found.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9a-f]{24,}", text):
        found.append((2, m.start(), m.end()))
    for m in re.finditer(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", text):
        if re.search(r"[0-9+/]", m[0]) and re.search(r"[A-Z]", m[0]) and re.search(r"[a-z]", m[0]):
            found.append((3, m.start(), m.end()))
    found += [(4, start, end) for start, end in endpoints(text)]
    return found


_RUN = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*")
_ENDING = re.compile(r"\.(?:amazonaws\.com|internal)\b", re.ASCII)
_OPENING = re.compile(r"\b[a-z0-9-]", re.ASCII)
_ADDRESS = re.compile(r"https?://[^\s\"'<>]+", re.ASCII)


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses, and host names with one of the fixed endings: (start, end), in time linear in the text.

    Host names are looked for from their endings: each lies in one run of labels, in which the name goes from the first
    word boundary to the last ending.
    """
    addresses = [m.span() for m in _ADDRESS.finditer(text)]
    endings = [m.span() for m in _ENDING.finditer(text)]
    found = list(addresses)
    if endings:
        nth, after = 0, 0
        for run in _RUN.finditer(text):
            while nth < len(endings) and endings[nth][0] < run.start():
                nth += 1
            if nth == len(endings):
                break
            while after < len(addresses) and addresses[after][1] <= run.start():
                after += 1
            low, high = run.span()
            if after < len(addresses):
                start, end = addresses[after]
                low, high = (max(low, end), high) if start <= low else (low, min(high, start))
            first, last = _OPENING.search(text, low, high) if low < high else None, None
            while nth < len(endings) and endings[nth][1] <= high:
                last = endings[nth] if first and endings[nth][0] > first.start() else last
                nth += 1
            if last:
                found.append((first.start(), last[1]))
    return sorted(found)


#: Texts without any of these hold no part; RE2 looks for them over a whole column at once.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/]{40}|https?://|\.amazonaws\.com|\.internal"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row, parts) of every document; row tells documents of equal doc_id and other text apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                hit = pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False)
                found = [[] for _ in range(len(texts))]
                for i in np.flatnonzero(hit).tolist():
                    found[i] = find_parts(texts[i].as_py())
                sizes = np.array([len(f) for f in found])
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.array([p for f in found for p in f], np.int32).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.ListArray.from_arrays(pa.array(at), items)], names=["doc_id", "row", "parts"])

    keyed = clean_texts(docs).select("doc_id", F.xxhash64("text").alias("row"), "text")
    return keyed.mapInArrow(run, "doc_id long, row long, parts array<struct<kind:int,start:int,end:int>>")


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with their complement within ``scope`` characters: (doc_id, row, kind, start, end).

    A bare key needs an access identifier; an endpoint needs both an access identifier and a secret (assigned or bare).
    Bare keys and endpoints inside a strong span are not candidates.
    """
    parts = found.where(F.exists("parts", lambda p: p["kind"] >= 3)).select("doc_id", "row", F.explode(F.array_distinct("parts")).alias("p")).select("doc_id", "row", "p.kind", "p.start", "p.end").distinct()
    cell = lambda c: F.floor(F.col(c) / scope)
    reach = lambda df: df.withColumn("cell", F.explode(F.sequence(cell("start") - 1, cell("end") + 1)))
    strong = parts.where("kind IN (0, 1, 3)").select("doc_id", "row", F.col("kind").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"))
    strong = strong.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / scope), F.floor(F.col("to") / scope))))
    weak = reach(parts.where("kind >= 3"))
    gap = F.greatest(F.col("from") - F.col("end"), F.col("start") - F.col("to"))
    pairs = weak.join(strong, ["doc_id", "row", "cell"]).where((gap <= scope) & ~((F.col("kind") == F.col("other")) & (F.col("start") == F.col("from"))))
    has = lambda kinds: F.max(F.col("other").isin(*kinds) & (gap > 0))
    inside = F.max((F.col("other") == 0) & (F.col("from") < F.col("end")) & (F.col("start") < F.col("to")))
    met = pairs.groupBy("doc_id", "row", "kind", "start", "end").agg(has((1,)).alias("access"), has((0, 3)).alias("secret"), inside.alias("inside"))
    return met.where(F.col("access") & ~F.col("inside") & ((F.col("kind") == 3) | F.col("secret"))).select("doc_id", "row", "kind", "start", "end")


def span_text(parts: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array_sort(F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"], p["end"])), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans of secrets in every whole text.

    ``docs`` needs doc_id and text; a null text counts as empty, and a document without secrets has zero counts and an
    empty list. Very long texts are scanned whole, in time linear in their length; spans of equal start are ordered by kind.
    Other columns are not looked at, whatever their names. Repeated rows are returned each for itself; rows without doc_id are scanned as well, without linking.
    Returns doc_id, n_assign, n_access, n_hex, n_linked, base_sha256 (digest of the strong spans' list), spans (all spans,
    the linked ones included).
    """
    found = materialized(scan(docs), "parts")
    linked = linked_parts(found, scope).groupBy("doc_id", "row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    joined = found.join(linked, ["doc_id", "row"], "left").withColumn("base", F.filter("parts", lambda p: p["kind"] < 3))
    more = F.coalesce("linked", F.slice("parts", 1, 0))
    count = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long")
    return joined.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size(more).cast("long").alias("n_linked"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", more)).alias("spans"),
    )
