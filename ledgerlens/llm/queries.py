"""Registered queries of the corpus operators: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


QUERIES: dict[str, Registered] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL statement where there is one."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = Registered(run, sql.strip() if sql else None)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without 50-byte strings that earlier documents hold."""
    from ledgerlens.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, folder, "documents"), length=50, keep_bytes=False)


def language_rows(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence of both tables in one form: pages declare a language in their markup, documents in their lang column."""
    from ledgerlens.llm.language_id import declared_in, host_of, visible_text

    none = F.lit(None).cast("long")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    web = pages.select(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), visible_text(F.col("html")).alias("text"), declared_in(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    return own.unionAll(web)


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document and page: text, declared language and host prior fused."""
    from ledgerlens.llm.language_id import fit, identify

    documents = table(spark, folder, "documents")
    rows = language_rows(documents, table(spark, folder, "pages"))
    return identify(rows, ["doc_id", "page_id"], *fit(documents))


LEAKS_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
  UNION
  SELECT DISTINCT 0, id, array_to_string(w[i:i + n - 1], ' ')
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words, (SELECT DISTINCT len(w) AS n FROM words WHERE kind = 1 AND len(w) BETWEEN 1 AND 4) WHERE kind = 0 AND len(w) >= n)),
items AS (SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS n_shingles FROM shingles WHERE kind = 1)
SELECT d.id AS doc_id, i.item_id, count(*) AS n_shared, i.n_shingles, count(*) / i.n_shingles AS containment
FROM shingles d JOIN items i ON d.shingle = i.shingle WHERE d.kind = 0
GROUP BY d.id, i.item_id, i.n_shingles HAVING count(*) >= ceil(i.n_shingles * 0.8 - 1e-9)
"""


@query(LEAKS_SQL)
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a benchmark item."""
    from ledgerlens.llm.decontaminate import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op4_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from ledgerlens.llm.simhash_dedup import simhash_components

    return simhash_components(table(spark, folder, "documents"), words=4, max_bits=4)


@query()
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document, linked parts included."""
    from ledgerlens.llm.secret_scan import find_secrets

    return find_secrets(table(spark, folder, "documents"))


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
places AS (
  SELECT doc_id, i AS place, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS block
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM docs WHERE len(lines) >= 3)
  WHERE trim(lines[i], ' ') <> '' OR trim(lines[i + 1], ' ') <> '' OR trim(lines[i + 2], ' ') <> ''),
ranked AS (
  SELECT doc_id, place, first_value(doc_id) OVER w AS first_doc, first_value(place) OVER w AS first_place
  FROM places WINDOW w AS (PARTITION BY block ORDER BY doc_id, place)),
gone AS (
  SELECT DISTINCT doc_id, place + k AS line FROM ranked, (SELECT unnest([0, 1, 2]) AS k)
  WHERE doc_id <> first_doc OR place >= first_place + 3),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs) AS l
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.line = l.i) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text, CAST(len(d.lines) AS BIGINT) AS n_lines, coalesce(c.n, 0) AS n_removed
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
"""


@query(LINES_SQL)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of three or more lines that stand in an earlier document or line."""
    from ledgerlens.llm.line_dedup import remove_repeated_lines

    return remove_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    from ledgerlens.llm.embedding_dedup import embedding_components

    return embedding_components(table(spark, folder, "embeddings"), threshold=0.9)


@query()
def op8_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document: contiguous runs of equal-text groups, the largest shard as small as can be."""
    from ledgerlens.llm.sharding import shard_documents

    placed = shard_documents(table(spark, folder, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, described from what was read back."""
    from ledgerlens.llm.token_files import token_table

    return token_table(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@query()
def op10_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """SentencePiece ids of every document, and the text decoded from them, as digests."""
    from ledgerlens.llm.piece_codec import encode_documents

    return encode_documents(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), keep_ids=False, keep_text=False)


@query()
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    from ledgerlens.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("places").alias("n_places"))


#: CRC-32 of a list of byte values.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
_DIGITS = "list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))"
_LEAF = "||".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
MERKLE_SQL = f"""
WITH RECURSIVE raw AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents),
marked AS (SELECT *, CASE WHEN xor(4294967295, {_CRC.format(bytes=_DIGITS)}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM raw),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, sha256({_LEAF.format(text='text')}) AS leaf, sha256({_LEAF.format(text='tampered')}) AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM marked),
nodes AS (
  SELECT grp, 0 AS lv, idx, n, leaf AS d FROM leaves
  UNION ALL SELECT grp, lv + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY grp, lv, idx // 3, n),
subroots AS (SELECT grp, d, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lv, idx, n, d FROM subroots
  UNION ALL SELECT lv + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lv, idx // 3, n),
runs AS (
  SELECT grp, lv, idx // 3 AS run, list(d ORDER BY idx) AS ds FROM nodes WHERE n > 1 GROUP BY grp, lv, idx // 3
  UNION ALL SELECT NULL, lv, idx // 3, list(d ORDER BY idx) FROM tops WHERE n > 1 GROUP BY lv, idx // 3),
steps AS (SELECT grp, lv, run, unnest(range(len(ds))) AS place, ds, len(ds) AS size FROM runs),
low AS (
  SELECT doc_id, grp, 0 AS lv, idx, changed AS now, '' AS proof FROM leaves
  UNION ALL SELECT w.doc_id, w.grp, w.lv + 1, w.idx // 3, sha256(array_to_string(ds[:place] || [now] || ds[place + 2:], '')), proof || array_to_string(ds[:place] || ds[place + 2:], '')
  FROM low w JOIN steps s ON s.grp = w.grp AND s.lv = w.lv AND s.run = w.idx // 3 AND s.place = w.idx % 3),
high AS (
  SELECT doc_id, 0 AS lv, s.idx, now, proof FROM (SELECT doc_id, grp, max_by(now, lv) AS now, max_by(proof, lv) AS proof FROM low GROUP BY doc_id, grp) JOIN subroots s USING (grp)
  UNION ALL SELECT w.doc_id, w.lv + 1, w.idx // 3, sha256(array_to_string(ds[:place] || [now] || ds[place + 2:], '')), proof || array_to_string(ds[:place] || ds[place + 2:], '')
  FROM high w JOIN steps s ON s.grp IS NULL AND s.lv = w.lv AND s.run = w.idx // 3 AND s.place = w.idx % 3),
ended AS (SELECT doc_id, max_by(now, lv) AS now, max_by(proof, lv) AS proof FROM high GROUP BY doc_id)
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.d AS verified
FROM leaves JOIN ended USING (doc_id) JOIN subroots s USING (grp), (SELECT d FROM tops WHERE n = 1) t
"""


@query(MERKLE_SQL)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Digest and proof of every document; half of them are checked with the line feeds taken out of their text."""
    from ledgerlens.llm.merkle_manifest import merkle_proofs

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_proofs(table(spark, folder, "documents"), tampered)


_BYTES = "list_transform(range(1, strlen(s) + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))"
VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7),
keyed AS (SELECT w, s, hex(encode(s)) AS x FROM (SELECT w, doc_id || ':' || w AS s FROM runs)),
hashed AS (SELECT w, xor(4294967295, {_CRC.format(bytes=_BYTES)}) AS h FROM keyed),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (SELECT word, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT p.word, count(*) AS n_near, arg_min(near, struct_pack(a := -w.n, b := encode(near))) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root, 0 AS hop FROM forms UNION ALL SELECT c.word, f.form, hop + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, max_by(root, hop) AS root FROM chain GROUP BY word) USING (word)
"""


@query(VARIANTS_SQL)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words of all documents, their more frequent near forms, and the roots of those chains."""
    from ledgerlens.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, folder, "documents"), min_length=7, min_count=2, ratio=10, typo_every=31)
