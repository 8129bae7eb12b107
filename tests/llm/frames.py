"""Small document tables for the tests of the corpus operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use inside or return.
CLASHES = ("component_id", "fingerprint", "h", "key", "row", "twin", "alt", "size", "shard", "slot", "start", "starts", "stops", "label", "node", "bits", "k1", "n_removed", "n_lines", "kept", "ids", "n_tokens", "file", "group_key", "cell", "w1", "at", "p", "host", "declared", "copy", "hit_id")

WORDS = "the and of stone river light under winter green paper house walked slowly because nothing else mattered today".split()


def frame(spark, rows, clashes=False):
    """Rows (doc_id, text) as a documents table; ``clashes`` adds columns with names that operators use."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def prose(seed, words):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "s", "ed", "ing")) + str(r.randint(0, 99)) * (r.random() < 0.2) for _ in range(words))


def edge_rows():
    """Nulls in both columns, empty, blank, very long and repeated texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [(None, "no id here"), (None, None), (1, None), (2, ""), (3, "  \n\n "), (4, "one"), (5, long), (6, long), (7, "é日本 \x00 𐍈 ﬁ"), (8, prose(2, 80)), (8, prose(2, 80)), (9, prose(3, 60)), (9, prose(4, 60)), (-10, prose(2, 80)), (11, "a\nb\nc\na\nb\nc\na\nb\nc")]
