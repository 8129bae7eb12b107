"""Merkle manifest of a dataset with proofs, by time-forward processing (operator 12).

Nodes are labelled by (level, position), children before parents. A sweep in label order takes the digests that were sent to
a node, computes its own and sends it to its parent; the reversed sweep sends from parents to children what is missing of
their proofs. What travels within a block of ``ARITY ** BLOCK_LEVELS`` neighbours waits in a heap ordered by label; what
travels between blocks waits in Spark's sorted shuffle, which is the external part of the queue: each task meets its
messages in label order, right before the nodes they are for, and never holds more than one block. A block root is a leaf of the next round, so
rounds are few, and every round is a written table: a lost executor costs a part of one round.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized, shuffle_parts

ARITY = 3
BLOCK_LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of a row's fields, each with its length in bytes; ``-`` stands for null."""
    found = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        found.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*found).cast("binary"), 256)


def leaf_table(docs: DataFrame, tampered_text: Column) -> DataFrame:
    """One narrow row for each document: no text goes any further."""
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first, then by bytes
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    changed = F.when(tampered_text.eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf_digest(text=tampered_text))
    return picked.select("doc_id", group.alias("grp"), leaf_digest().alias("digest"), changed.alias("tampered"), F.monotonically_increasing_id().alias("row"))


def indexed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with their position ``idx`` from 0 within ``grp`` in the given order, and the group's size ``n``.

    Rows are range-partitioned by group and order together, so a large group is many ranges; a range adds the counts of
    the group's earlier ranges to its own positions.
    """
    ranged = rows.repartitionByRange(shuffle_parts(rows), "grp", *order).withColumn("range_no", F.spark_partition_id())
    ranged = materialized(ranged, label)
    counts = ranged.groupBy("grp", "range_no").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("grp").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "range_no", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("grp")).alias("n"))
    place = F.row_number().over(Window.partitionBy("grp", "range_no").orderBy(*order)) - 1
    placed = ranged.withColumn("place", place).join(counts, ["grp", "range_no"])
    return placed.select(*rows.columns, (F.col("before") + F.col("place")).alias("idx"), "n")


def levels_over(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels, width = 0, 1
    while width < n:
        levels, width = levels + 1, width * ARITY
    return levels


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climbed(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of all nodes of a block, level by level: the sweep in label order."""
    queue = [(0, i, d) for i, d in enumerate(digests)]
    found: list[list[str]] = [[] for _ in range(levels + 1)]
    last, children = len(digests) - 1, []
    while queue:
        level, i, digest = heapq.heappop(queue)
        found[level].append(digest)
        if level == levels:
            continue
        children.append(digest)
        if len(children) == ARITY or i == last:
            heapq.heappush(queue, (level + 1, i // ARITY, hashed(*children)))
            children = []
            last = last // ARITY if i == last else last
    return found


def descended(found: list[list[str]], suffix: str) -> list[str]:
    """For each leaf of a block the siblings up to the root, as ``left.right;`` for each level: the reversed sweep."""
    queue = [(1 - len(found), 0, suffix)]
    paths = [""] * len(found[0])
    while queue:
        level, i, path = heapq.heappop(queue)
        if level == 0:
            paths[i] = path
            continue
        below = found[-level - 1]
        start, stop = ARITY * i, min(ARITY * i + ARITY, len(below))
        for k in range(start, stop):
            heapq.heappush(queue, (level + 1, k, f"{''.join(below[start:k])}.{''.join(below[k + 1 : stop])};{path}"))
    return paths


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its siblings give."""
    for step in path.split(";")[:-1]:
        left, right = step.split(".")
        leaf = hashed(left, leaf, right)
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one block after the other from a stream sorted by (grp, block, idx)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _swept(rows: DataFrame, work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each block; the first columns are grp, block and idx."""
    fields = [c.split() for c in schema.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.bool_() if kind == "boolean" else pa.string() for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[n for n, _ in fields])
        for block in _blocks(batches):
            found += work(block)
            if len(found) >= 4096:
                yield full()
                found = []
        if found:
            yield full()

    dealt = rows.repartition(shuffle_parts(rows), "grp", "block").sortWithinPartitions("grp", "block", "idx")
    return dealt.mapInArrow(run, schema)


def _block() -> Column:
    return F.floor(F.col("idx") / ARITY**BLOCK_LEVELS).alias("block")


def rounds_up(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (grp, idx, n, digest): the given leaves, then the block roots of each round, until each group has one."""

    def work(rows: list[tuple]) -> list[tuple]:
        (grp, block, _, n, _), width = rows[0], ARITY**BLOCK_LEVELS
        top = climbed([r[4] for r in rows], min(BLOCK_LEVELS, levels_over(n)))[-1]
        return [(grp, block, -(-n // width), top[0])]

    tables = [nodes]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rows = tables[-1].select("grp", _block(), "idx", "n", "digest")
        tables.append(materialized(_swept(rows, work, "grp string, idx long, n long, digest string"), "merkle-up"))
    return tables


def _with_messages(nodes: DataFrame, messages: DataFrame, own: list[str]) -> DataFrame:
    """Nodes and the message to each block, which sorts before them."""
    none = [F.lit(None).cast("string").alias(c) for c in ("path", "subroot")]
    rows = nodes.select("grp", _block(), "idx", "n", "digest", *own, *none)
    kinds = dict(nodes.dtypes)
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in ("n", "digest", *own)]
    return rows.unionAll(messages.select("grp", "block", F.lit(-1).cast("long").alias("idx"), *blank, "path", "subroot"))


def _paths(block: list[tuple]) -> tuple[list[tuple], list[str], str | None]:
    """Nodes of a block, their paths to the root, and the group's subroot."""
    *_, suffix, subroot = block[0]
    nodes = block[1:]
    found = climbed([r[4] for r in nodes], min(BLOCK_LEVELS, levels_over(nodes[0][3])))
    return nodes, descended(found, suffix), subroot


def paths_down(tables: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Paths of the nodes of the first of ``tables`` (grp, block, path, subroot), from messages to the single blocks of the last."""

    def work(block: list[tuple]) -> list[tuple]:
        nodes, paths, subroot = _paths(block)
        return [(r[0], r[2], path, subroot) for r, path in zip(nodes, paths, strict=True)]

    for nodes in reversed(tables):
        rows = _with_messages(nodes, messages, [])
        messages = materialized(_swept(rows, work, "grp string, block long, path string, subroot string"), "merkle-down")
    return messages


def merkle_proofs(docs: DataFrame, tampered_text: Column) -> DataFrame:
    """Digest, root and proof of every document, and what the root would be with its text replaced by ``tampered_text``.

    ``docs`` needs doc_id, source, lang, n_chars and text; other columns are not looked at, whatever their names. Per source
    (null is a source of its own and comes first) leaves ascend by doc_id (null first; ties by digest, then by place in
    the input); every three consecutive nodes become one until one is left, and the sources' roots likewise. Repeated rows
    are leaves of their own. Empty and very long texts are hashed whole. A null tampered text means an untampered null.
    An empty table gives an empty result. Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    spark = docs.sparkSession
    leaves = materialized(leaf_table(docs, tampered_text), "merkle-leaves")
    leaves = materialized(indexed(leaves, ["doc_id", "digest", "row"], "merkle-ranges"), "merkle-nodes")
    tables = rounds_up(leaves)
    subroots = tables[-1].select("grp", "digest")
    tops = indexed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"], "merkle-sources")
    top_tables = rounds_up(materialized(tops, "merkle-sources"))
    found = top_tables[-1].select("digest").first()
    root = found[0] if found else ""
    start = spark.range(1 if found else 0).select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("block"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
    to_sources = paths_down(top_tables[: max(1, len(top_tables) - 1)], start)
    named = top_tables[0].select(F.col("name"), F.col("idx").alias("block"), F.col("digest").alias("own_root")).join(to_sources, "block")
    messages = named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("own_root").alias("subroot"))
    messages = paths_down(tables[1:-1], messages)

    def work(block: list[tuple]) -> list[tuple]:
        nodes, paths, subroot = _paths(block)
        rows = []
        for r, path in zip(nodes, paths, strict=True):
            again = folded(r[6] or r[4], path)
            rows.append((r[5], r[4], subroot, root, hashed(path.replace(".", "").replace(";", "")), again, again == root))
        return rows

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _swept(_with_messages(tables[0], messages, ["doc_id", "tampered"]), work, schema)
