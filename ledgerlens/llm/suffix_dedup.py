"""Removal of repeated byte strings by longest-previous-factor arrays (operator 1).

A string of ``length`` bytes is filed under its anchor, the smallest hash of the k-grams in it, so equal strings are filed
together. Strings that start one after the other and have the same anchor are handled as one context. Contexts of anchors
that occur in two documents are compared: a context that a smaller document holds as well goes whole; where an anchor has
several contexts, a suffix array is built over them, previous and next smaller documents in suffix order give the longest
earlier match of every position, and matches of ``length`` bytes mark what goes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import clean_texts, materialized, ragged, shuffle_parts, slices, string_from, string_parts

LENGTH = 50
GRAM = 20
CHUNK = 1 << 20
FILTER_BITS = 27
CROWD = 20_000
#: Strings of crowded anchors that are compared in a task before they are shuffled.
SETTLED_ROWS = 200_000

BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values, reach = pick(values[:-reach], values[reach:]), reach * 2
    return pick(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def contexts(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, anchor hash) of runs of strings of ``length`` bytes with one anchor, within one row each.

    Every string that lies within a row is in exactly one run; a run has no more strings than an anchor has places. Works
    through the bytes in chunks that overlap, so memory does not grow with a row.
    """
    width = length - gram + 1
    n_up = min(CHUNK, max(len(data), 1)) + length
    up, down = _powers(BASE, n_up), _powers(INVERSE, n_up)
    starts, counts, hashes = [], [], []
    for a in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[a : a + CHUNK + length - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
        least = _sliding(h, width, np.minimum)  # of the string that starts here
        whole = np.ones(len(least), bool)
        edges = at[np.searchsorted(at, a, "right") : np.searchsorted(at, a + n, "left")] - a
        for low, high in zip(np.maximum(edges - length + 1, 0).tolist(), edges.tolist(), strict=True):
            whole[low:high] = False  # strings across rows
        opens = whole.copy()
        opens[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        start = np.flatnonzero(opens)
        shut = ~whole
        shut |= opens
        ends = np.append(np.flatnonzero(shut), len(least))
        size = ends[np.searchsorted(ends, start, "right")] - start
        pieces = -(-size // width)  # a long run, as of one repeated byte, is cut
        if (pieces > 1).any():
            order = ragged(np.zeros(len(start), np.int64), pieces)
            start, size, pieces = np.repeat(start, pieces), np.repeat(size, pieces), None
            start, size = start + order * width, np.minimum(size - order * width, width)
        m = least[start]
        m ^= m >> np.uint64(33)  # smallest hashes crowd together: spread them again, one to one
        m *= np.uint64(BASE)
        m ^= m >> np.uint64(31)
        starts.append(start + a)
        counts.append(size)
        hashes.append(m)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *counts]), np.concatenate([none.astype(np.uint64), *hashes])


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    sorted_ = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if none, by jumping over larger ones."""
    back = np.arange(len(values)) - 1
    live = np.flatnonzero(back >= 0)
    while len(live):
        live = live[values[back[live]] >= values[live]]
        back[live] = back[back[live]]
        live = live[back[live] >= 0]
    return back


def longest_previous(data: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a string of ``length`` bytes starts within its row, and their longest previous factors.

    The factor of a position is the longest prefix, of ``length`` bytes at most, of its suffix that also starts in a row of
    a smaller ``owner``. Suffixes are ordered by prefix doubling of ranks; the best match of a suffix is its neighbour in
    that order, upwards or downwards, among those of smaller owners.
    """
    size = np.diff(at)
    starts = np.maximum(size - length + 1, 0)
    spot = ragged(at[:-1], starts)
    if not len(spot):
        return spot, spot
    who = np.repeat(owner, starts)
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)])
    n = len(padded) - 8
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + n]
    levels, width, rank = {8: _ranks(words)}, 8, None
    while width * 2 <= length:
        rank = levels[width]
        tail = np.concatenate([rank[width:], np.zeros(width, np.int64)])
        levels[width * 2] = _ranks((rank << 32) | tail)
        width *= 2
    rank = levels[width]
    order = np.lexsort((who, (rank[spot] << 32) | rank[spot + length - width]))
    spot, who = spot[order], who[order]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, up to ``length``."""
        shared = np.zeros(len(a), np.int64)
        for step in (*sorted(levels, reverse=True), 4, 2, 1):
            fits = shared + step <= length
            left, right = a + shared, b + shared
            if step >= 8:
                same = levels[step][left] == levels[step][right]
            else:
                cut = np.uint64(64 - 8 * step)
                same = (words[left] >> cut) == (words[right] >> cut)
            shared += step * (fits & same)
        return shared

    before = previous_smaller(who)
    after = len(who) - 1 - previous_smaller(who[::-1])[::-1]  # len(who): none
    best = np.zeros(len(who), np.int64)
    for near, there in ((before, before >= 0), (after, after < len(who))):
        i = np.flatnonzero(there)
        best[i] = np.maximum(best[i], common(spot[i], spot[near[i]]))
    return spot, best


def _fold(n: int) -> int:
    """Bits that tell buckets of hashes apart, for about a million hashes in each of 64 to a million buckets."""
    return min(20, max(6, int(np.ceil(np.log2(max(n, 1) / (1 << 20) + 1)))))


def _assembled(rows: DataFrame, fold: int, bits: int) -> np.ndarray:
    """One bit string of 2^bits bits out of (bucket, bits) rows: a fixed size, whatever the input."""
    whole, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (bits - fold - 3)
    for r in rows.toLocalIterator():
        whole[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return whole


def _packed(bucket: int, tops: np.ndarray, fold: int, bits: int) -> pa.Table:
    marks = np.zeros(1 << (bits - fold), bool)
    marks[tops - (bucket << (bits - fold))] = True
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})


def _hash_filter(hashes: DataFrame, n: int, bits: int) -> np.ndarray:
    """A filter that holds every ``h`` of ``hashes``."""
    fold = min(_fold(n), bits - 3)

    def pack(table: pa.Table) -> pa.Table:
        return _packed(table.column("bucket")[0].as_py(), table.column("top").to_numpy(), fold, bits)

    top = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.select(top.alias("top")).withColumn("bucket", F.shiftright("top", bits - fold).cast("int"))
    return _assembled(rows.groupBy("bucket").applyInArrow(pack, "bucket int, bits binary"), fold, bits)


def _passes(marks: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    top = (h >> np.uint64(64 - bits)).astype(np.int64)
    return ((marks[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1).astype(bool)


def _shared_filter(texts: DataFrame, total_bytes: int, length: int, gram: int, bits: int) -> np.ndarray:
    """A filter that holds every anchor hash that occurs in two documents.

    The filter has a fixed size. Where it is crowded it lets other anchors through, which costs work and changes nothing.
    Hashes are combined in each slice of a task before they are shuffled, so a hash in very many documents arrives once
    for each slice; a bit tells that the slice had it twice. As many bytes of a hash are sent as keep chance meetings rare.
    """
    n = total_bytes // 8
    fold = min(_fold(n), bits - 3)
    kept = int(np.clip(np.ceil((2 * np.log2(max(n, 2)) - fold - 2) / 8), 4, 8))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                data, at = string_parts(part.column("text"))
                spot, _, h = contexts(data, at, length, gram)
                order = np.argsort(h)
                h, row = h[order], (np.searchsorted(at, spot, "right") - 1)[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                if not len(first):
                    continue
                several = np.maximum.reduceat(row, first) > np.minimum.reduceat(row, first)
                h = h[first]
                edge = np.searchsorted(h >> np.uint64(64 - fold), np.arange((1 << fold) + 1, dtype=np.uint64))
                sent = ((h << np.uint64(fold)) >> np.uint64(1)) | (several.astype(np.uint64) << np.uint64(63))
                raw = sent.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :kept]
                full = np.flatnonzero(np.diff(edge))  # buckets follow one another, so the cuts of the full ones are all there are
                packed = string_from(np.ascontiguousarray(raw).ravel(), np.append(edge[full], edge[-1]) * kept, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), packed], names=["bucket", "hashes"])

    def merge(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, kept)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :kept] = raw
        h = wide.view(">u8").ravel().astype(np.uint64)
        several = (h >> np.uint64(63)).astype(bool)
        h &= np.uint64((1 << 63) - 1)
        order = np.sort(h)
        again = np.concatenate([h[several], order[1:][order[1:] == order[:-1]]])
        bucket = table.column("bucket")[0].as_py()
        tops = ((again << np.uint64(1)) >> np.uint64(64 - (bits - fold))).astype(np.int64) + (bucket << (bits - fold))
        return _packed(bucket, tops, fold, bits)

    rows = texts.mapInArrow(gather, "bucket int, hashes binary")
    return _assembled(rows.groupBy("bucket").applyInArrow(merge, "bucket int, bits binary"), fold, bits)


def _sliced(part: pa.RecordBatch, marks: np.ndarray, length: int, gram: int, bits: int) -> tuple:
    """Contexts of a slice whose anchors pass the filter, ordered by anchor, digest and doc_id: (h, k, row, start, size),
    the bytes with their offsets, and the first one of each anchor and digest."""
    import xxhash

    data, at = string_parts(part.column("text"))
    spot, count, h = contexts(data, at, length, gram)
    kept = _passes(marks, h, bits)
    spot, h, size = spot[kept], h[kept].view(np.int64), count[kept] + length - 1
    view = memoryview(data)
    k = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(spot.tolist(), (spot + size).tolist(), strict=True)), np.uint64, len(spot)).view(np.int64)
    row = np.searchsorted(at, spot, "right") - 1
    doc = part.column("doc_id").to_numpy()[row]
    order = np.lexsort((doc, k, h))
    h, k, row, spot, size, doc = (x[order] for x in (h, k, row, spot, size, doc))
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]) if len(h) else np.empty(0, bool)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    return h, k, row, spot - at[row], size, data, spot, doc > doc[lead]


def _packed_spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for a start and a size below 65,536."""
    return (start << 16) | size


def _whole_contexts(texts: DataFrame, marks: np.ndarray, length: int, gram: int, bits: int) -> DataFrame:
    """Rows (doc_id, alt, span) of contexts that a smaller document holds as well, and a row (h, n, fresh) for each kind of
    context of an anchor: in how many places it is left.

    Within a slice, contexts behind the first of their kind are settled at once, so a context of very many documents
    reaches the shuffle once for each slice. Each task then streams through its contexts in order and holds none.
    """
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                h, k, row, start, size, _, _, settled = _sliced(part, shared.value, length, gram, bits)
                spread = np.where(settled, (start * 0x9E3779B1) ^ h, h)
                take = pa.array(row)
                columns = [pa.array(spread), pa.array(k), pa.array(settled), part.column("doc_id").take(take), part.column("alt").take(take), pa.array(_packed_spans(start, size))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "k", "settled", "doc_id", "alt", "span"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h0 = k0 = first0 = None
        for batch in batches:
            h, k, settled, doc, alt, span = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield _answer(doc[settled], alt[settled], span[settled])
            h, k, doc, alt, span = (x[~settled] for x in (h, k, doc, alt, span))
            if len(h):
                new = np.concatenate([[h0 is None or h[0] != h0 or k[0] != k0], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
                first = np.where(lead < 0, first0 or 0, doc[lead])
                gone = doc > first
                yield _answer(doc[gone], alt[gone], span[gone])
                head = np.union1d([0], np.flatnonzero(new))  # the first context may go on from the batch before
                yield _told(h[head], np.diff(np.append(head, len(h))), new[head])
                h0, k0, first0 = h[-1], k[-1], int(first[-1])

    def _answer(doc: np.ndarray, alt: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none.cast(pa.bool_()), pa.array(doc), pa.array(alt), pa.array(span)], names=names)

    def _told(h: np.ndarray, n: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(fresh), none, none, none], names=names)

    names = ["h", "n", "fresh", "doc_id", "alt", "span"]
    rows = texts.mapInArrow(split, "h long, k long, settled boolean, doc_id long, alt long, span long")
    dealt = rows.repartition(shuffle_parts(texts), "h", "k").sortWithinPartitions("h", "k", "doc_id")
    return dealt.mapInArrow(stream, "h long, n long, fresh boolean, doc_id long, alt long, span long")


def _context_bytes(texts: DataFrame, marks: np.ndarray, length: int, gram: int, bits: int) -> DataFrame:
    """(h, doc_id, alt, start, seg): bytes of the contexts that pass the filter, each kind once for a slice."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                h, _, row, start, size, data, spot, settled = _sliced(part, shared.value, length, gram, bits)
                kept = ~settled
                h, row, start, size, spot = h[kept], row[kept], start[kept], size[kept], spot[kept]
                take = pa.array(row)
                segments = string_from(data[ragged(spot, size)], np.concatenate([[0], np.cumsum(size)]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc_id").take(take), part.column("alt").take(take), pa.array(start), segments], names=["h", "doc_id", "alt", "start", "seg"])

    return texts.mapInArrow(run, "h long, doc_id long, alt long, start long, seg binary")


def _by_factors(found: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, alt, span) of what longest previous factors of ``length`` bytes cover."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        owner, alt, start = (table.column(c).to_numpy() for c in ("doc_id", "alt", "start"))
        data, at = string_parts(table.column("seg").combine_chunks())
        spot, factor = longest_previous(data, at, owner, length)
        hit = np.sort(spot[factor >= length])
        row = np.searchsorted(at, hit, "right") - 1
        opens = np.concatenate([[True], (row[1:] != row[:-1]) | (hit[1:] - hit[:-1] > length)]) if len(hit) else np.empty(0, bool)
        closes = np.append(opens[1:], True) if len(hit) else opens
        row, low, high = row[opens], hit[opens], hit[closes] + length
        span = _packed_spans(start[row] + low - at[row], high - low)
        return pa.RecordBatch.from_arrays([pa.array(owner[row]), pa.array(alt[row]), pa.array(span)], names=["doc_id", "alt", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last anchor may go on in the next batch
            if cut:
                yield solve(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    dealt = found.repartition(shuffle_parts(found), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "doc_id long, alt long, span long")


def _by_strings(found: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts, which would make one task large: strings are dealt out by content.

    Of a string's places in one batch only those of its smallest document are open; the others are settled where they
    stand. So a string of very many documents reaches the task of its content once for each batch. Each task streams through its
    strings in order and holds none.
    """
    placed = found.withColumn("o", F.explode(F.sequence(F.lit(0), F.octet_length("seg") - length)))
    cut = F.substring("seg", F.col("o") + 1, F.lit(length))
    strings = placed.select("doc_id", "alt", (F.col("start") + F.col("o")).alias("start"), F.xxhash64(cut).alias("s1"), F.xxhash64(F.lit(1), cut).alias("s2"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if not held or (batch is not None and sum(b.num_rows for b in held) < SETTLED_ROWS):
                continue
            table = pa.Table.from_batches(held)
            held = []
            doc, alt, start, s1, s2 = (table.column(c).to_numpy() for c in ("doc_id", "alt", "start", "s1", "s2"))
            order = np.lexsort((doc, s2, s1))
            doc, alt, start, s1, s2 = (x[order] for x in (doc, alt, start, s1, s2))
            fresh = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]) if len(doc) else np.empty(0, bool)
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
            settled = doc > doc[lead]
            # all places of one document follow from its first one: the span is what is left to tell
            spread = np.where(settled, s1 ^ (start * 0x9E3779B1) ^ doc, s1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, s2, settled, doc, alt, _packed_spans(start, np.full(len(start), length)))], names=["s1", "s2", "settled", "doc_id", "alt", "span"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, 0
        for batch in batches:
            s1, s2, settled, doc, alt, span = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            gone = settled.copy()
            at = np.flatnonzero(~settled)
            if len(at):
                a, b, d = s1[at], s2[at], doc[at]
                new = np.concatenate([[key != (a[0], b[0])], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
                least = np.where(lead < 0, first, d[lead])
                gone[at] = d > least
                key, first = (a[-1], b[-1]), int(least[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (doc, alt, span)], names=["doc_id", "alt", "span"])

    rows = strings.mapInArrow(settle, "s1 long, s2 long, settled boolean, doc_id long, alt long, span long")
    dealt = rows.repartition(shuffle_parts(found), "s1", "s2").sortWithinPartitions("s1", "s2", "doc_id")
    return dealt.mapInArrow(stream, "doc_id long, alt long, span long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = FILTER_BITS, crowd: int = CROWD, keep_bytes: bool = True) -> DataFrame:
    """Take every byte covered by a ``length``-byte string that also starts in a document of smaller doc_id out of ``docs``.

    ``docs`` needs doc_id and text; texts are UTF-8 bytes, a null one is empty, and matches never cross documents. Strings
    are judged on the input; overlaps count. Very long texts are searched whole, in chunks that overlap; other columns are not
    looked at, whatever their names. Texts shorter than ``length`` stay whole. Rows of equal doc_id never match
    each other; repeated rows are returned each for itself, with equal results. Rows without doc_id are neither searched
    nor changed. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, kept (the remaining
    bytes).
    """
    if not 8 <= gram < length or not 16 <= length < 1 << 15:
        raise ValueError("an anchor has at least 8 bytes and is shorter than the string, which has 16 to 32,767")
    base = clean_texts(docs).withColumn("twin", F.xxhash64("text"))
    marks = materialized(base.where("doc_id IS NOT NULL").select("doc_id", "twin", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n")), "marks")
    firsts = marks.groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = marks.join(firsts, "sha").where("doc_id > first").select("doc_id", "twin")
    clashes = marks.groupBy("doc_id").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where("low <> high").select("doc_id")
    clashing = marks.join(clashes, "doc_id", "left_semi").select("doc_id", "twin")
    notes = copies.withColumn("copy", F.lit(True)).unionAll(clashing.withColumn("copy", F.lit(False)))
    notes = notes.groupBy("doc_id", "twin").agg(F.max("copy").alias("copy"), F.min("copy").alias("plain")).select("doc_id", "twin", "copy", (~F.col("plain")).alias("clash"))
    notes = materialized(notes, "notes")
    total = marks.agg(F.sum("n")).first()[0] or 0
    # alt tells texts of one doc_id apart; it is 0 for nearly all documents, so that it costs nothing to carry.
    noted = base.join(notes, ["doc_id", "twin"], "left").select("doc_id", "text", F.when(F.col("clash"), F.col("twin")).otherwise(F.lit(0).cast("long")).alias("alt"), F.coalesce("copy", F.lit(False)).alias("copy"))
    texts = noted.where("doc_id IS NOT NULL AND NOT copy").select("doc_id", "alt", "text")

    shared = _shared_filter(texts, total, length, gram, bits)
    first_look = materialized(_whole_contexts(texts, shared, length, gram, bits), "contexts")
    covered = first_look.where("span IS NOT NULL").select("doc_id", "alt", "span")
    anchors = first_look.where("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n"), F.count_if("fresh").alias("kinds")).where("kinds > 1")
    anchors = materialized(anchors.select("h", "n"), "anchors")
    counts = anchors.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > crowd, 1))).first()
    if counts[0] > counts[1]:
        marked = _hash_filter(anchors.where(F.col("n") <= crowd).select("h"), counts[0], bits)
        covered = covered.unionAll(_by_factors(_context_bytes(texts, marked, length, gram, bits), length))
    if counts[1]:
        marked = _hash_filter(anchors.where(F.col("n") > crowd).select("h"), counts[1], bits)
        covered = covered.unionAll(_by_strings(_context_bytes(texts, marked, length, gram, bits), length))
    lists = covered.groupBy("doc_id", "alt").agg(F.collect_list("span").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = string_parts(batch.column("text"))
            copy = batch.column("copy").to_pylist()
            n_removed, n_spans, digest, rest = [], [], [], []
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                gone = np.full(len(own), copy[i] and len(own) >= length)
                spans = batch.column("spans")[i].values
                if spans is not None:
                    spans = spans.to_numpy()
                    change = np.bincount(spans >> 16, minlength=len(own) + 1) - np.bincount((spans >> 16) + (spans & 0xFFFF), minlength=len(own) + 1)
                    gone |= np.cumsum(change[:-1]) > 0
                kept = own[~gone].tobytes()
                n_removed.append(len(own) - len(kept))
                n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any()))
                digest.append(hashlib.sha256(kept).hexdigest())
                if keep_bytes:
                    rest.append(kept)
            columns = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                columns, names = [*columns, pa.array(rest, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    joined = noted.join(lists, ["doc_id", "alt"], "left").select("doc_id", "text", "copy", "spans")
    return joined.mapInArrow(cut, schema)
