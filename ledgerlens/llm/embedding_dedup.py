"""Near-duplicate embeddings by int8 tile products with error bounds (operator 7).

Unit vectors are quantised to int8 with a scale of their own; the length of what rounding took away bounds how far a
product of codes can be from the cosine. Blocks of vectors meet in tiles, whose products are exact integer sums; only pairs
whose bound reaches the threshold are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized
from ledgerlens.llm.components import connected_components, joined_labels

THRESHOLD = 0.9
BLOCK = 4096
STRIP = 128
SLACK = 1e-9  # far above double rounding in the sums of a bound


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, and for each unit vector the length of its rounding error."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(1)) + SLACK
    return codes, scale, error


def tile_strips(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Index pairs with a cosine of ``threshold`` or more, in strips, and how many pairs were computed in full precision.

    ``left`` and ``right`` are unit vectors in double precision; with ``same``, pairs i < j alone. A strip holds
    ``STRIP`` rows of the tile, so memory does not follow the number of near pairs.
    """
    (a, sa, ea), (b, sb, eb) = quantised(left), quantised(right)
    # Sums of int8 products are exact in single precision up to 1,040 components.
    kind = np.float32 if left.shape[1] <= 1040 else np.float64
    codes = b.astype(kind).T
    for low in range(0, len(left), STRIP):
        product = a[low : low + STRIP].astype(kind) @ codes
        # |x.y - sa sb (a.b)| <= ea + (1 + ea) eb; first with the block's largest scale and error, then with each pair's own.
        own_s, own_e = sa[low : low + STRIP], ea[low : low + STRIP]
        least = (threshold - own_e - (1 + own_e) * eb.max()) / own_s
        least = np.where(least >= 0, least / sb.max(), least / sb.min())
        i, j = np.nonzero(product >= least[:, None] - 1e-3)
        value = product[i, j] * own_s[i] * sb[j] + own_e[i] + (1 + own_e[i]) * eb[j]
        near = value >= threshold
        if same:
            near &= i + low < j
        i, j = i[near] + low, j[near]
        exact = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            exact[k : k + (1 << 14)] = np.einsum("ij,ij->i", left[i[k : k + (1 << 14)]], right[j[k : k + (1 << 14)]]) >= threshold
        yield i[exact], j[exact], len(i)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links of every vector to others with a cosine of at least ``threshold``, and its component.

    ``vectors`` needs vec_id and embedding (an array of float or double); other columns are not looked at. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of different lengths with
    each other. Equal vectors are one node, so copies cost nothing; they count each other as links, repeated rows as well.
    Rows without vec_id count as links of others and join their components; their own component is null if no vector in it has
    an id. Ties and other columns' names play no part. All pairs of distinct vectors are covered by tiles, so the work grows
    with the square of their number, spread evenly over tasks; what a tile returns grows with its rows alone. Returns
    vec_id, n_links, component_id, kept.
    """
    embedding = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding, _usable(embedding).alias("usable"))
    keyed = rows.withColumn("k1", F.when(F.col("usable"), F.xxhash64("embedding"))).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    named = materialized(keyed.select("vec_id", "k1", "k2"), "vector-ids")
    nodes = keyed.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    nodes = materialized(nodes, "vectors")
    # nodes that no row with an id holds are numbered past the largest id
    largest = nodes.agg(F.max("node")).first()[0]
    largest = -1 if largest is None else largest
    nodes = nodes.withColumn("node", F.coalesce("node", F.lit(largest + 1) + F.monotonically_increasing_id()))
    nodes = materialized(nodes, "vectors") if nodes.where(F.col("node") > largest).limit(1).count() else nodes
    blocks = max(1, -(-nodes.count() // block))

    own = F.pmod(F.xxhash64("k1"), F.lit(blocks)).cast("int")
    dealt = nodes.select("node", "copies", "embedding", F.size("embedding").alias("dim"), own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select("node", "copies", "embedding", "own", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def solve(table: pa.Table) -> pa.Table:
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        values = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        raw = values.reshape(table.num_rows, -1)
        raw = raw / np.abs(raw).max(1, keepdims=True)
        unit = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
        node, copies, block_no = (table.column(c).to_numpy() for c in ("node", "copies", "own"))
        left, right = np.flatnonzero(block_no == first), np.flatnonzero(block_no == second)
        links = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        if len(left) and len(right):
            for p, q, _ in tile_strips(unit[left], unit[right], threshold, first == second):
                p, q = left[p], right[q]
                links += np.bincount(p, copies[q], len(node)).astype(np.int64) + np.bincount(q, copies[p], len(node)).astype(np.int64)
                label = joined_labels(label, p, q)
        hung, linked = np.flatnonzero(label != np.arange(len(node))), np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([node[label[hung]], node[linked]])),
            "b": pa.array(np.concatenate([node[hung], node[linked]])),
            "links": pa.array(np.concatenate([np.zeros(len(hung), np.int64), links[linked]])),
        })

    found = materialized(tiles.groupBy("dim", "i", "j").applyInArrow(solve, "a long, b long, links long"), "tile-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("a <> b").select("a", "b"))
    known = nodes.select("k1", "k2", "node", "copies").join(counts, "node", "left").join(labels, "node", "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id"))
    joined = named.join(known, ["k1", "k2"], "left")
    known_id = F.when(F.col("component_id") <= largest, F.col("component_id"))
    component = F.when(F.col("component_id").isNotNull(), known_id).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
