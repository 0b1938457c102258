import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peerlens.llm import bpe, tokenfiles

TEXTS = ["", None, "Hello  world\n\n x'll we'Re", "aaaaaaaaaaaaaaaa" * 50, "ab" * 3000, "élan — 東京 🎉 ١٢٣", "<|endoftext|> a\x1cb\x85c d", "  lead", "trail  ", "ä é", "\x00 \x00"]


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe_equals_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + TEXTS[:2])]
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    library = reference()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(bpe.encode_documents(docs, keep=("doc_id",))).collect()}
    assert got == {1: b"one two", 2: b""}


@pytest.fixture(scope="module")
def pair():
    return bpe.text_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), reference()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60) | st.text("ab ", max_size=80))
def test_bpe_property(pair, text):
    own, library = pair
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(gaps):
    values = np.cumsum(gaps)
    code = tokenfiles.EliasFano(len(values), *tokenfiles.EliasFano.encode(values))
    assert code.selects(np.arange(len(values))).tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(t, i, "x") for i, t in reversed(rows)], "text string, doc_id long, ids string")
    files = tokenfiles.write_token_files(docs, path, block_ids=50)
    got = {r.doc_id: r for r in tokenfiles.read_documents(files).collect()}
    at = 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_of_nothing_and_null_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.read_documents(tokenfiles.write_token_files(empty, path)).count() == 0
    docs = spark.createDataFrame([(None, "a"), (5, None), (5, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfiles.read_documents(tokenfiles.write_token_files(docs, path)).collect())
    assert got == [(0, None, 2), (2, 5, 1), (3, 5, 1)]


@pytest.fixture(scope="module")
def word_pieces():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenfiles._piece_cache(path)[0], Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=40) | st.text("aBÉéßŒœŁİıÅſǅŉΣς.,'s1 \n-", max_size=30))
def test_pieces_equal_library(word_pieces, text):
    cache, library = word_pieces
    got = np.frombuffer(cache.ids([text])[0], "<u2").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids
