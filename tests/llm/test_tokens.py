"""Token counts and the codec against the library itself."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    None, "", " ", "a", "\n\na", "a \n b", "don't we'll 'S ''s €'s x'll", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>",
    "\u00a0\u2003x\u3000\u3000y", "\x1c\x1d a\x85b", "ünï çödé \U0001f980\u200d\U0001f980", "1234 ½ ² ४२", "x" * 5000, "qj" * 3000, "ab " * 4000, "a\u0301e\u0301", "\ufffd", "\t\t\tif x:\r\n\r\n  y", "a\x00b", "!'re ?'ve", "don’t",
]


def library(texts):
    return token_counts.tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_counts_are_the_librarys(spark):
    want = {k: len(e.ids) for k, e in enumerate(library(HARD))}
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts.count_tokens(rows(spark, HARD).repartition(3), PATH).collect()}
    assert got == {k: (n, len((HARD[k] or "").encode()), n > 1024) for k, n in want.items()}


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(rows(spark, []), PATH).count() == 0


def test_codec_is_the_librarys(spark):
    want = {k: e.ids for k, e in enumerate(library(HARD))}
    encoded = bpe.encode(rows(spark, HARD), PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, PATH).collect()} == {k: t or "" for k, t in enumerate(HARD)}
    for r in bpe.encode(rows(spark, HARD), PATH, digest=True).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((HARD[r.doc_id] or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sretvldm.,aé€\u3000\u00a0<|>!9"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_any_text(texts):
    own = bpe.codec(PATH)
    for got, counted, want in zip(own.encode([t.encode() for t in texts]), [token_counts.splitter()(t) for t in texts], library(texts), strict=True):
        assert bpe._ids(got) == want.ids
        assert sum(len(e.ids) for e in library(counted)) == len(want.ids)


@pytest.mark.parametrize("query", ["op2_token_counts", "op4_bpe_codec"])
def test_queries_on_the_small_table(spark, query):
    from rostrum.llm.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(source, map(len, (e.ids for e in library(source.values()))), strict=True))
    assert {r.doc_id: r.n_tokens for r in QUERIES[query](spark, folder).collect()} == want
