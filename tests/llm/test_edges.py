"""Every operator and stage on nulls, ties, repeated rows, clashing columns, very long texts and empty tables."""

import pytest
import public_tokenizers

import corpus_pipeline
from ledgerlens.llm.decontaminate import contaminated
from ledgerlens.llm.embedding_dedup import embedding_components
from ledgerlens.llm.language_id import fit, identify
from ledgerlens.llm.license_scan import scan_licenses
from ledgerlens.llm.line_dedup import remove_repeated_lines
from ledgerlens.llm.merkle_manifest import merkle_proofs
from ledgerlens.llm.piece_codec import encode_documents
from ledgerlens.llm.secret_scan import find_secrets
from ledgerlens.llm.sharding import shard_documents
from ledgerlens.llm.simhash_dedup import simhash_components
from ledgerlens.llm.suffix_dedup import remove_repeats
from ledgerlens.llm.token_files import token_table
from tests.llm.frames import edge_rows, frame

OPERATORS = {
    "repeats": remove_repeats,
    "lines": remove_repeated_lines,
    "simhash": simhash_components,
    "secrets": find_secrets,
    "shards": shard_documents,
    "licenses": scan_licenses,
    "proofs": lambda docs: merkle_proofs(docs, docs["text"]),
    "tokens": lambda docs: token_table(docs, public_tokenizers.path("word_bpe_49k.json"), 1),
    "pieces": lambda docs: encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    docs = frame(spark, edge_rows(), clashes=True)
    found = OPERATORS[name](docs).collect()
    assert len(found) == len(edge_rows())
    assert sorted((r["doc_id"] for r in found), key=lambda i: (i is None, i or 0)) == sorted((i for i, _ in edge_rows()), key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null(spark, name):
    assert len(OPERATORS[name](frame(spark, [(None, None), (None, None), (1, None)])).collect()) == 3


def test_stages_keep_columns(spark, tmp_path):
    items = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (edge_rows(), [], [(None, None)]):
        docs = frame(spark, rows, clashes=True)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "encoding" or out.columns == docs.columns
            assert out.count() <= len(rows)


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "some text"), (2, None)]).selectExpr("doc_id", "text", "cast(null as string) AS lang", "source")
    languages, logs = fit(docs)
    assert languages == []
    rows = docs.selectExpr("doc_id", "text", "lang AS declared", "source AS host")
    assert [r["kept"] for r in identify(rows, ["doc_id"], languages, logs).collect()] == [False, False]


def test_contamination_edges(spark):
    docs = frame(spark, edge_rows(), clashes=True)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()] == [(4, 3)]
    assert contaminated(docs, items.limit(0)).collect() == []
    assert contaminated(docs.limit(0), items).collect() == []


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (10, [1.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (None, [0.0, 1.0]), (12, [-0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, node string, links string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(vectors).collect()}
    assert found[1] == (3, 1, True) and found[2] == (3, 1, False) and found[11] == (3, 1, False)
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8))
    assert found[9] == (1, 9, True) and found[10] == (1, 9, False)
    assert embedding_components(vectors.limit(0)).collect() == []
