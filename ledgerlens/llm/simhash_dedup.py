"""SimHash near-duplicates found by pigeonhole blocks (operator 4).

A fingerprint is cut into ``max_bits + 2`` blocks. Two fingerprints that differ in at most ``max_bits`` bits agree in at
least two whole blocks, so they share the key of some pair of blocks. Fingerprints are joined on these keys and pairs are
verified by their Hamming distance. Equal fingerprints are one node from the start; a key with very many fingerprints is
split into tiles, so that every pair of its parts meets in some task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized, ragged, shuffle_parts, slices, string_parts
from ledgerlens.llm.components import connected_components, joined_labels

SEED = 42
TILE = 2048


def simhashes(texts: pa.Array, words: int = 4) -> np.ndarray:
    """Fingerprints of null-free texts: A-Z lowered, words between ASCII white space, XXH64 of their shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data, at = string_parts(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    some = np.diff(at) > 0
    start[at[:-1][some]] = solid[at[:-1][some]]
    stop[at[1:][some] - 1] = solid[at[1:][some] - 1]
    begin, lengths = np.flatnonzero(start), np.flatnonzero(stop) + 1 - np.flatnonzero(start)
    ends = np.cumsum(lengths + 1)  # in a copy with one space after each word
    packed = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    packed[ragged(ends - lengths - 1, lengths)] = data[ragged(begin, lengths)]
    first = np.searchsorted(begin, at)  # words of row i: first[i] .. first[i + 1] - 1
    n_words = np.diff(first)
    shingles = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
    head = ragged(first[:-1], shingles)
    tail = head + np.repeat(np.minimum(n_words, words), shingles) - 1
    low, high = (ends - lengths - 1)[head].tolist(), (ends - 1)[tail].tolist()
    view = packed.tobytes()
    hashes = np.fromiter((digest(view[i:j], SEED) for i, j in zip(low, high, strict=True)), np.uint64, len(low))
    out = np.zeros(len(n_words), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        begins = (np.cumsum(shingles) - shingles)[full]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > shingles[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 4, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(key, bits) of every whole text; bits is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                bits = simhashes(part.column("text"), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in key], pa.array(bits)], names=[*key, "bits"])

    rows = docs.select(*[F.col(c).cast("long").alias(c) for c in key], F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in key) + ", bits long")


def block_masks(max_bits: int) -> list[int]:
    """Masks, as signed longs, of every pair out of ``max_bits + 2`` blocks of a fingerprint."""
    n = max_bits + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    masks = [x | y for x, y in itertools.combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(max_bits: int):
    """Compares the rows of each key and gives the links that join its sets: fewer than rows, never all pairs."""

    def compare(key: np.ndarray, bits: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        rest = np.repeat(edge + size, size) - np.arange(len(key))  # rows from here to the end of the key
        label, live, step = np.arange(len(key)), np.flatnonzero(rest > 1), 1
        while len(live):
            near = live[np.bitwise_count(bits[live] ^ bits[live + step]) <= max_bits]
            if len(near):
                label = joined_labels(label, near, near + step)
            step += 1
            live = live[rest[live] > step]
        hung = np.flatnonzero(label != np.arange(len(key)))
        return node[label[hung]], node[hung]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [batch.column("key").to_numpy(), batch.column("bits").to_numpy().view(np.uint64), batch.column("node").to_numpy()]
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held[0], columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            held = [tuple(c[cut:] for c in columns)]
            if cut:
                a, b = compare(*(c[:cut] for c in columns))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held and len(held[0][0]):
            a, b = compare(*held[0])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_links(nodes: DataFrame, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all ``nodes`` (node, bits; bits distinct) within ``max_bits`` bits of each other.

    Every pair within the distance is compared, since it shares a key and, of a split key, a tile; of the pairs found,
    those that join two sets of a tile are returned.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mask")) for k, m in enumerate(block_masks(max_bits))])
    rows = nodes.select("node", "bits", F.explode(masks).alias("m")).select("node", "bits", F.col("m.k").alias("k"), F.col("bits").bitwiseAND(F.col("m.mask")).alias("v"))
    sizes = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = rows.join(sizes, ["k", "v"])
    parts = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("bits"), parts).cast("int")
    tiles = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    keyed = tiles.select("node", "bits", F.xxhash64("k", "v", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    dealt = keyed.repartition(shuffle_parts(nodes), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(max_bits), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, words: int = 4, max_bits: int = 4, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(key, bits, label): fingerprint of every row and the smallest fingerprint (as a signed number) it is linked to.

    Fingerprints are the nodes, so rows without doc_id take part like any other.
    """
    prints = materialized(fingerprints(docs, words, key), "fingerprints")
    nodes = materialized(prints.select("bits").distinct().select(F.col("bits").alias("node"), "bits"), "fingerprint-nodes")
    labels = materialized(connected_components(near_links(nodes, max_bits)), "fingerprint-labels")
    return prints.join(labels, F.col("bits") == F.col("node"), "left").select(*key, "bits", F.coalesce("label", "bits").alias("label"))


def simhash_components(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """Fingerprint of every document, and the smallest doc_id reachable over links of at most ``max_bits`` bits.

    ``docs`` needs doc_id and text; other columns are not looked at, whatever their names. A null or blank text has
    fingerprint zero and is linked like any other; very long texts are taken whole. Repeated rows are returned each for
    itself; ties do not occur. Documents without doc_id link others and get the component of their group, null if no document
    in it has an id. Returns doc_id, fingerprint (16 lowercase hex digits), component_id.
    """
    groups = simhash_groups(docs, words, max_bits)
    owners = groups.groupBy("bits", "label").agg(F.min("doc_id").alias("own"))
    firsts = materialized(owners.groupBy("label").agg(F.min("own").alias("component_id")), "fingerprint-groups")
    return groups.join(firsts, "label").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
