"""Token ids as Parquet list columns, written for selective reads and read back (operator 9).

One row for each document: doc_id, n_tokens and the ids, with the end id. Files hold ascending ranges of doc_id and are
sorted within; row groups are small and ids dictionary-encoded (a vocabulary is a small set), doc_id and n_tokens
delta-encoded where the writer's version allows it, all with page indexes. A reader of doc_id ranges skips files and pages
by their statistics; a reader of n_tokens alone never opens the id pages.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import clean_texts, ragged, shuffle_parts, slices, string_from, string_parts
from ledgerlens.session import scratch_path

FILE_OPTIONS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2",
    "compression": "zstd",
}

KNOWN_UNITS = 300_000


def _separable(tokenizer) -> bool:
    """Whether white space only separates words, and every word ends in a token of its own kind."""
    parts = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("ab cd\nab", "ab", "cd", " \n")]
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    return bool(suffix) and parts[0] == parts[1] + parts[2] + parts[1] and not parts[3]


def _word_ends(tokenizer) -> np.ndarray:
    """By id: whether the token ends a word."""
    suffix, words = tokenizer.model.end_of_word_suffix, tokenizer.get_vocab()
    ends = np.zeros(max(words.values()) + 1, bool)
    ends[[i for token, i in words.items() if token.endswith(suffix)]] = True
    return ends


def _encode_units(units: list[str], plain: np.ndarray, tokenizer, ends: np.ndarray, known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units and the number of ids of each. ``plain`` units are one word each: these are encoded many at a time
    and parted again at the tokens that end words. ``known`` remembers units, as bytes of their ids, for the next call."""
    if len(known) > KNOWN_UNITS:
        known.clear()
    new = [u not in known for u in units]
    words = [u for u, n, p in zip(units, new, plain.tolist(), strict=True) if n and p]
    for low in range(0, len(words), 5_000):
        take = words[low : low + 5_000]
        texts = [" ".join(take[k : k + 50]) for k in range(0, len(take), 50)]
        ids = np.fromiter((i for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids), np.int32)
        stop = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(stop) != len(take) or stop[-1] != 4 * len(ids):
            raise ValueError("the tokenizer does not end every word with a token of its own kind")
        raw = ids.tobytes()
        known.update((u, raw[i:j]) for u, i, j in zip(take, [0, *stop[:-1]], stop, strict=True))
    others = [u for u, n, p in zip(units, new, plain.tolist(), strict=True) if n and not p]
    for low in range(0, len(others), 5_000):
        take = others[low : low + 5_000]
        known.update((u, np.array(e.ids, np.int32).tobytes()) for u, e in zip(take, tokenizer.encode_batch_fast(take, add_special_tokens=False), strict=True))
    found = [known[u] for u in units]
    return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes spell an ASCII or Latin-1 letter."""
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A)
    pair = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[:-1] |= pair
    letter[1:] |= pair
    return letter


def encode_words(texts: pa.Array, tokenizer, ends: np.ndarray | None, known: dict[str, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of null-free texts and the offsets of each text's ids.

    With ``ends`` (see ``_word_ends``), texts are cut into units that no token crosses, and each distinct unit is encoded
    once by the library: at spaces and line feeds, and between a letter and ASCII punctuation or digits, but not beside an
    apostrophe. Without, the library encodes the texts whole.
    """
    data, at = string_parts(texts)
    if ends is None:
        coded = [e.ids for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
    gap = (data == 0x20) | (data == 0x0A)
    letter = _letters(data)
    start = ~gap
    if len(data):
        other = (data < 0x80) & ~letter & ~gap & (data != 0x27)
        cut = (letter[:-1] & other[1:]) | (other[:-1] & letter[1:])
        if b"<|" in data.tobytes():  # special tokens may be spelled out
            cut[:] = False
        start[1:] &= gap[:-1] | cut
        first = at[:-1][np.diff(at) > 0]
        start[first] = ~gap[first]
    last = np.append(start[1:] | gap[1:], True) & ~gap if len(data) else start
    last[at[1:][np.diff(at) > 0] - 1] = ~gap[at[1:][np.diff(at) > 0] - 1]
    starts = np.flatnonzero(start)
    lengths = np.flatnonzero(last) + 1 - starts
    coded = string_from(data[~gap], np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    raw, raw_at = string_parts(coded.dictionary)
    odd = np.concatenate([[0], np.cumsum(~_letters(raw))])
    plain = odd[raw_at[1:]] == odd[raw_at[:-1]]
    flat, sizes = _encode_units(coded.dictionary.to_pylist(), plain, tokenizer, ends, {} if known is None else known)
    per_unit = sizes[index]
    ids = flat[ragged((np.cumsum(sizes) - sizes)[index], per_unit)]
    return ids, np.concatenate([[0], np.cumsum(per_unit)])[np.searchsorted(starts, at)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, options: dict[str, str] | None = None) -> None:
    """Encode every whole text and write the files under ``path`` in ascending order of doc_id.

    A null text counts as empty (the end id alone). Repeated rows are written each for itself, ordered by text among equal
    doc_id; rows without doc_id come first. Extra columns are not looked at. Texts, not ids, are shuffled: they are the
    smaller of the two. A task writes one range of doc_id; ranges are cut by sampled keys, so no key makes a task large.
    """

    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((loaded, _word_ends(loaded) if _separable(loaded) else None))  # fixed by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        own, ends = shared.value
        known: dict[str, bytes] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encode_words(part.column("text"), own, ends, known)
                n = len(at) - 1
                out_at = at + np.arange(n + 1)
                out = np.full(len(ids) + n, end_id, np.int32)
                body = np.ones(len(out), bool)
                body[out_at[1:] - 1] = False
                out[body] = ids
                lists = pa.ListArray.from_arrays(pa.array(out_at.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(out_at).astype(np.int64)), lists], names=["doc_id", "n_tokens", "ids"])

    texts = clean_texts(docs)
    ordered = texts.repartitionByRange(shuffle_parts(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")
    rows.write.options(**FILE_OPTIONS | (options or {})).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), low: int | None = None, high: int | None = None) -> DataFrame:
    """Chosen columns of the files, for doc_id in [low, high] where given: both reach the Parquet scan."""
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.select(*columns)


def describe_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files: each document's start (ids of all documents before it), n_tokens, and crc32 of its ids.

    Positions come in two steps, so that no window sees the whole table: totals of files, added up in the order of their
    first doc_id (one row for each file), and running sums within each file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * at[i] : 4 * at[i + 1]]) for i in range(len(at) - 1)]
            columns = [batch.column("doc_id"), pc.list_value_length(lists).cast(pa.int64()), pa.array(sums, pa.int64()), batch.column("file"), batch.column("row")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    stored = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    rows = stored.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    digests = rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, file string, row long")
    files = stored.select(F.col("_metadata.file_name").alias("file"), "n_tokens", "doc_id").groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "file")).alias("first"))
    before = files.select("file", (F.sum("total").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    within = digests.withColumn("running", running)
    return within.join(before, "file").select("doc_id", (F.col("before") + F.col("running") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` in the shared scratch folder and describe them from what was written.

    A null text counts as empty, very long texts are encoded whole, repeated rows each for themselves in a fixed order; an
    empty table gives an empty result. Other columns are not looked at, whatever their names.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return describe_tokens(docs.sparkSession, path)
