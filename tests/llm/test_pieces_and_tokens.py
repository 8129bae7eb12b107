import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm.piece_codec import PieceCodec, encode_documents
from ledgerlens.llm.token_files import _separable, _word_ends, describe_tokens, encode_words, read_tokens, token_table, write_tokens
from tests.llm.frames import frame

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "th", "The", "é", "É", "×", "日", "́", "'", "'s", "'re", ".", ",", "!", "1", "23", "½", " ", "  ", "\n", "\t", "\r", " ", "<", "|", "<|", "ß", "ſ", "Σ", "-", "\x00", "▁", "𐍈", "inger", "<s>", "<0x41>", "<|endoftext|>", ";\r", "= ="]


def texts(n=1500):
    r = random.Random(5)
    odd = ["", " ", "▁", "▁▁a", "aaaaaaa", "there" * 200, "=" * 700, "        x" * 3]
    return odd + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_pieces_equal_the_library():
    own, library = PieceCodec.of_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = texts()
    ids, at = own.encode(pa.array(rows))
    expected = library.encode(rows, add_bos=True, add_eos=True)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(rows))] == expected
    assert own.decode(ids, at) == [library.decode(e).encode() for e in expected]


def test_long_words_equal_the_library():
    import time

    own, library = PieceCodec.of_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(6)
    letters = lambda n, of: "".join(r.choice(of) for _ in range(n))
    rows = [" " * 20_000, letters(100_000, "abcdefghijklmnopqrstuvwxyz"), "ab" * 3000, "\n" * 4000, letters(20_000, "的一是不了人我在有他这为"), "é" * 500 + "🙂" * 300]
    rows += ["x" * n for n in (127, 128, 129, 130)] + [letters(300, "aeinrst") + " " + letters(90, "aeinrst")]
    start = time.time()
    ids, at = own.encode(pa.array(rows))
    own.encode(pa.array([letters(1 << 20, "abcdefghijklmnopqrstuvwxyzABC/+0123456789")]))
    assert time.time() - start < 60
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(rows))] == library.encode(rows, add_bos=True, add_eos=True)


def test_any_ids_decode_like_the_library():
    own, library = PieceCodec.of_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    rows = [[r.choice([0, 1, 2, 35, 130, 195, 196, 200, 230, 240, 259, 261, 1500, 28705, 28709]) for _ in range(r.randint(0, 9))] for _ in range(2000)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    assert own.decode(np.array([y for x in rows for y in x], np.int32), at) == [library.decode(x).encode() for x in rows]


def test_encoded_documents(spark):
    rows = list(enumerate(texts(50))) + [(900, None)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in encode_documents(frame(spark, rows), MODEL).collect():
        expected = library.encode(dict(rows)[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids"] == expected and r["n_tokens"] == len(expected)
        assert r["decoded"] == library.decode(expected)


def test_words_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    ends = _word_ends(library)
    for rows in (texts(), [t for t in texts() if "<|" not in t]):
        ids, at = encode_words(pa.array(rows), library, ends)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(rows))] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_a_tokenizer_that_keeps_space_encodes_whole_texts():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not _separable(library)
    ids, at = encode_words(pa.array(["a b", "", "c"]), library, None)
    assert ids[at[0] : at[1]].tolist() == library.encode("a b", add_special_tokens=False).ids and at[1] == at[2]


def test_files_hold_documents_in_order(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts(80))] + [(500, None)]
    library, start = Tokenizer.from_file(WORDS), 0
    found = {r["doc_id"]: r for r in token_table(frame(spark, rows), WORDS, 1).collect()}
    for doc_id, text in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (found[doc_id]["start"], found[doc_id]["n_tokens"]) == (start, len(ids))
        assert found[doc_id]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_selective_reads(spark, tmp_path):
    path = f"{tmp_path}/tokens"
    write_tokens(frame(spark, [(i, f"word {i}") for i in range(200)]), path, WORDS, 1)
    some = read_tokens(spark, path, ("doc_id", "n_tokens"), 20, 29)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(20, 30))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0].replace("doc_ids", "")
    assert describe_tokens(spark, path).count() == 200


@pytest.mark.parametrize("text", ["", "a", "a\n\nb", "é́ ' 's"])
def test_single_texts(text):
    library = Tokenizer.from_file(WORDS)
    assert encode_words(pa.array([text]), library, _word_ends(library))[0].tolist() == library.encode(text, add_special_tokens=False).ids
