"""The corpus pipeline: documents to token ids, in five stages that each call one operator of ``ledgerlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized
from ledgerlens.llm.decontaminate import contaminated
from ledgerlens.llm.language_id import fit, identify
from ledgerlens.llm.line_dedup import edited_lines
from ledgerlens.llm.piece_codec import encode_documents
from ledgerlens.llm.queries import table, vocabulary
from ledgerlens.llm.simhash_dedup import simhash_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language can be made out; the others pass unchanged.

    A document is judged by its text, its declared ``lang`` and its ``source``. Null, empty or letterless texts go.
    Repeated rows are judged alike and all stay or go; rows without doc_id are judged like any other.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("twin"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    judged = identify(rows, ["doc_id", "twin"], *fit(docs))
    rejected = materialized(judged.where(~F.col("kept")).select("doc_id", "twin").distinct(), "rejected")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))) == F.col("twin"))
    return whole.join(rejected, same, "left_anti").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated runs of lines out of the texts; a document of which no line is left goes.

    ``n_chars`` is counted again where a text changed. Null texts stay null, and texts that were empty before stay.
    """
    left = edited_lines(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    count = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    changed = {"text": F.col("text"), "n_chars": count}
    return left.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def _marked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows told apart by a 128-bit hash (k1, k2) of doc_id and text, nulls included: whole as ``doc``, and (k1, k2, doc_id, text).

    So rows without doc_id, and rows of one doc_id with other texts, are judged each for itself; repeated rows are alike.
    """
    parts = [F.col(c).isNull() for c in ("doc_id", "text")] + [F.col("doc_id"), F.col("text")]
    keys = [F.xxhash64(F.lit(n), *parts).alias(f"k{n}") for n in (1, 2)]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *keys)
    return whole, docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), "text")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group linked by SimHash (4 words, 4 bits).

    Rows without doc_id take part and stay where no row of their group has one (ties: by hash). Of repeated rows one stays.
    """
    whole, rows = _marked(docs)
    groups = simhash_groups(rows, words=4, max_bits=4, key=("k1", "k2", "doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first")
    chosen = materialized(groups.groupBy("label").agg(first).select("first.k1", "first.k2"), "chosen")
    return whole.join(chosen, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold at least 0.8 of the five-word shingles of a test item of ``benchmark``, with or without doc_id."""
    whole, rows = _marked(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), key=("k1", "k2"))
    leaks = materialized(found.select("k1", "k2").distinct(), "leaks")
    return whole.join(leaks, ["k1", "k2"], "left_anti").select("doc.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with digests of the ids and of the text decoded from them."""
    return encode_documents(docs, vocabulary("piece_bpe_32k.model"), keep_text=False).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express trigram models, fingerprints and merges; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
