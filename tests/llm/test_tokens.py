"""Token counts and byte-level BPE against the public libraries."""

import struct
import unicodedata

import public_tokenizers
import pytest
from conftest_llm import edge_rows, sorted_rows

from clipquest.llm import bpe, token_counts
from clipquest.llm.queries import BYTE_RANKS, PIECE_MODEL, public_file


@pytest.fixture(scope="module")
def model():
    return public_file(PIECE_MODEL)


@pytest.fixture(scope="module")
def ranks():
    return public_file(BYTE_RANKS)


@pytest.mark.parametrize("frequent", [100_000, 5, 0])
def test_token_counts(edges, model, frequent):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = token_counts.token_counts(edges, model, limit=100, frequent=frequent)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = []
    for i, text in edge_rows():
        n = len(library.encode(text or ""))
        expected.append((i, len((text or "").encode()), n, n > 100))
    assert sorted_rows(found) == sorted(expected, key=str)


def test_token_counts_of_nothing(make, model):
    assert token_counts.token_counts(make([]), model).count() == 0


@pytest.mark.parametrize("frequent", [100_000, 5, 0])
def test_byte_bpe(edges, ranks, frequent):
    library = bpe._encoding(ranks, public_tokenizers.PATTERN)
    encoded = bpe.encode(edges, ranks, public_tokenizers.PATTERN, frequent=frequent)
    found = bpe.decode(encoded, ranks).select("doc_id", "n_tokens", "ids", "decoded")
    expected = []
    for i, text in edge_rows():
        ids = library.encode_ordinary(text or "")
        expected.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_byte_bpe_of_nothing(make, ranks):
    assert bpe.encode(make([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_words_may_be_encoded_apart(ranks):
    """Every character, between and beside spaces, gives the ids of the whole text."""
    library = bpe._encoding(ranks, public_tokenizers.PATTERN)
    odd = [chr(c) for c in range(0x3100) if unicodedata.category(chr(c)) != "Cs"]
    for c in [*odd, "﻿", "​", "\U0001f600"]:
        for text in (f"a {c} b", f"a{c} {c}b", f"{c}  {c} ", f" {c}\n {c}"):
            ids = [i for w in bpe._written(text) for i in library.encode_ordinary(bpe._read(w))]
            assert ids == library.encode_ordinary(text), repr(text)


def test_decode_refuses_unknown_ids(spark, ranks):
    bad = spark.createDataFrame([(1, bytearray(struct.pack("<I", 10**6)))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="index out of range"):
        bpe.decode(bad, ranks).collect()
