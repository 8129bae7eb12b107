"""Language identification by fusing evidence in Bayes' way (operator 2).

The text speaks through hashed byte trigrams (naive Bayes, length-tempered), the markup through the language it declares,
and the address through a prior that is smoothed from its host over its domain and suffix to the whole table. All tables
but the trigram model are grouped sums of the text's posteriors over every row, with the row itself left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialized, slices, string_parts
from ledgerlens.session import small_side

BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
SPAN = 1 << 30
HELD_LANGUAGES = 64
GATHER_CELLS = 1 << 24
EFFECTIVE_GRAMS = 60
STRENGTH = 5.0
MIN_POSTERIOR = 0.5


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of null-free texts, and the offsets of each text's. Trigrams stay within a text.

    A-Z are lowered; ASCII bytes that are no letters count as spaces; trigrams whose middle is a space are left out.
    """
    data, at = string_parts(texts)
    low = data | 0x20
    letter = (data >= 0x80) | ((low >= 0x61) & (low <= 0x7A))
    plain = np.where(letter, np.where(data >= 0x80, data, low), 0x20).astype(np.uint32)
    padded = np.concatenate([[np.uint32(0x20)], plain, [np.uint32(0x20)]])
    before, after = padded[:-2].copy(), padded[2:].copy()
    some = np.diff(at) > 0
    before[at[:-1][some]] = 0x20
    after[at[1:][some] - 1] = 0x20
    code = ((before << 16) | (plain << 8) | after) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return code[letter].astype(np.int32), np.concatenate([[0], np.cumsum(letter)])[at]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (bucket x language) from about ``sample_rows`` labelled rows (text, lang) of each.

    Every label that occurs is a language, however rare. The rows of each are sampled by a hash of their content, so a
    recomputed task draws the same ones; its rate follows the distinct contents of the language, so copies of a text neither
    thin out the others nor are all that is drawn. Languages of fewer rows are used whole. The model takes 256 KB a language
    in the driver and in each Python worker. Returns no languages where no row is labelled.
    """
    content = F.xxhash64("text", "lang")
    named = labelled.where("lang IS NOT NULL").select("text", "lang")
    labels = named.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("text").isNotNull(), content)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in labels.collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    bounds = [(lang, i, int(SPAN * min(1.0, sample_rows / max(sizes[lang], 1)))) for i, lang in enumerate(languages)]
    drawn = small_side(labelled.sparkSession.createDataFrame(bounds, "lang string, language int, below long"))
    rows = named.where(F.col("text").isNotNull()).join(drawn, "lang").where(F.pmod(content, F.lit(SPAN)) < F.col("below")).select("text", "language")

    def told(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used])], names=["language", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                code, at = grams(part.column("text"))
                for k, i in enumerate(part.column("language").to_pylist()):
                    if i not in sums:
                        if len(sums) == HELD_LANGUAGES:
                            yield from told(sums)
                            sums = {}
                        sums[i] = np.zeros(BUCKETS, np.int64)
                    np.add.at(sums[i], code[at[k] : at[k + 1]], 1)
        yield from told(sums)

    found = materialized(rows.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    logs = np.empty((BUCKETS, len(languages)), np.float32)
    for low in range(0, len(languages), HELD_LANGUAGES):
        high = min(low + HELD_LANGUAGES, len(languages))
        cells = found.where(F.col("language").between(low, high - 1)).toArrow()
        table = np.zeros((BUCKETS, high - low))
        table[cells.column("bucket").to_numpy(), cells.column("language").to_numpy() - low] = cells.column("n").to_numpy()
        logs[:, low:high] = np.log((table + 0.5) / (table.sum(0, keepdims=True) + 0.5 * BUCKETS))
    return languages, logs


def _text_posteriors(rows: DataFrame, keys: list[str], logs: np.ndarray, effective: int) -> DataFrame:
    """keys, declared, host, n_grams, and ``p``: the text's posterior under equal priors."""
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    n = logs.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                code, at = grams(part.column("text"))
                size = np.diff(at)
                sums = np.zeros((len(size), n))
                full = np.flatnonzero(size)
                step = max(1, GATHER_CELLS // max(len(code), 1))  # languages at a time, so that many need no more memory
                for low in range(0, n if len(full) else 0, step):
                    sums[full, low : low + step] = np.add.reduceat(table[:, low : low + step][code], at[:-1][full], axis=0, dtype=np.float64)
                sums *= (np.minimum(size, effective) / np.maximum(size, 1))[:, None]
                p = np.exp(sums - sums.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), n).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], part.column("declared"), part.column("host"), pa.array(size), lists], names=[*keys, "declared", "host", "n_grams", "p"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", declared string, host string, n_grams long, p array<double>"
    return rows.select(*keys, "text", "declared", "host").mapInArrow(score, schema)


def host_of(url: Column) -> Column:
    """Host of an address, lower-cased, without port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def declared_in(html: Column) -> Column:
    """Language that the html element declares, empty if there is none."""
    return F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments, tags and entities."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def identify(rows: DataFrame, keys: list[str], languages: list[str], logs: np.ndarray, min_posterior: float = MIN_POSTERIOR, effective: int = EFFECTIVE_GRAMS, strength: float = STRENGTH) -> DataFrame:
    """Language of every row of ``rows`` (the ``keys``, text, declared, host), with the posterior of the fused evidence.

    ``declared`` and ``host`` may be null or empty: then they say nothing beyond the prior. A null text counts as empty,
    and a text without letters has no text evidence. ``kept`` is false for these, and where no language reaches
    ``min_posterior``. Very long texts are read whole, in evidence worth ``effective`` grams at most; of languages with equal posteriors
    the first in alphabetical order is answered. Repeated rows are judged each for itself. With no languages everything is rejected, with a null
    language. Returns keys, lang, posterior, text_lang, n_grams, kept.
    """
    if not languages:
        nothing = F.lit(None)
        return rows.select(*keys, nothing.cast("string").alias("lang"), nothing.cast("double").alias("posterior"), nothing.cast("string").alias("text_lang"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("kept"))
    span = range(len(languages))
    clean = rows.select(
        *keys,
        F.coalesce("text", F.lit("")).alias("text"),
        F.lower(F.coalesce("declared", F.lit(""))).alias("declared"),
        F.lower(F.coalesce("host", F.lit(""))).alias("host"),
    )
    scored = materialized(_text_posteriors(clean, keys, logs, effective), "text-posteriors")
    said = F.when(F.col("n_grams") > 0, F.col("p"))
    sums = [F.sum(F.get(said, F.lit(i))).alias(f"s{i}") for i in span]
    plus = lambda prefix: F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in span]).alias(prefix)
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in span]

    # Sums by host, then of hosts by domain and by suffix, then of all; each level is joined to its hosts, not to rows.
    hosts = scored.groupBy("host").agg(*sums)
    labels = F.split("host", r"\.")
    hosts = hosts.withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(labels, -1))
    hosts = materialized(hosts, "hosts")
    whole = hosts.agg(*again).first()
    total = [float(x or 0.0) for x in whole]
    domains = hosts.groupBy("domain").agg(*again).select("domain", plus("in_domain"))
    suffixes = hosts.groupBy("suffix").agg(*again).select("suffix", plus("in_suffix"))
    levels = hosts.select("host", "domain", "suffix", plus("in_host")).join(domains, "domain").join(suffixes, "suffix").select("host", "in_host", "in_domain", "in_suffix")
    declared = scored.groupBy("declared").agg(*sums).select("declared", plus("in_declared"))

    own = F.when(F.col("n_grams") > 0, F.col("p")).otherwise(F.array(*[F.lit(0.0)] * len(languages)))
    joined = scored.withColumn("own", own).join(levels, "host").join(declared, "declared")

    def smoothed(name: str, above: Column) -> Column:
        rest = F.zip_with(name, "own", lambda s, o: F.greatest(s - o, F.lit(0.0)))
        weight = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) + strength
        return F.zip_with(rest, above, lambda s, q: (s + strength * q) / weight)

    base = F.array(*[F.lit((t + 1.0) / (sum(total) + len(languages))) for t in total])
    prior = joined.withColumn("q0", smoothed("in_suffix", base)).withColumn("q1", smoothed("in_domain", F.col("q0"))).withColumn("q2", smoothed("in_host", F.col("q1")))
    # P(declared | language), smoothed to the declaration's share of all rows.
    rest = F.zip_with("in_declared", "own", lambda s, o: F.greatest(s - o, F.lit(0.0)))
    share = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / max(sum(total), 1.0)
    sizes = F.array(*[F.lit(t) for t in total])
    claim = F.zip_with(rest, sizes, lambda s, t: (s + strength * share + 1e-6) / (t + strength))
    fused = prior.withColumn("claim", claim).withColumn("joint", F.zip_with(F.zip_with("q2", "claim", lambda a, b: a * b), "p", lambda a, b: a * F.greatest(b, F.lit(1e-30))))
    best, said_best = F.array_max("joint"), F.array_max("p")
    names = F.array(*[F.lit(x) for x in languages])
    posterior = best / F.aggregate("joint", F.lit(0.0), lambda a, x: a + x)
    return fused.select(
        *keys,
        F.get(names, F.array_position("joint", best).cast("int") - 1).alias("lang"),
        posterior.alias("posterior"),
        F.when(F.col("n_grams") > 0, F.get(names, F.array_position("p", said_best).cast("int") - 1)).alias("text_lang"),
        "n_grams",
        ((F.col("n_grams") > 0) & (posterior >= min_posterior)).alias("kept"),
    )
