import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.tokenize import PATTERN, VOCABULARY, Encoder, encode_documents, merge_ranks, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
RANKS = read_ranks(open(VOCABULARY, "rb").read()) if os.path.exists(VOCABULARY) else {}


def public(text):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_same_ids_as_the_public_library(text):
    ids = Encoder(RANKS, memory=8).encode(text)
    assert ids == public(text)
    back = {v: k for k, v in RANKS.items()}
    assert b"".join(back[i] for i in ids) == text.encode()


def test_one_long_piece():
    text = "abab" * 3000
    assert merge_ranks(text.encode(), RANKS) == public(text)


def test_table(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (4, "<|endoftext|>", "x"), (None, " ", "x")]
    got = [(r.doc_id, r.ids) for r in encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()]
    assert sorted(got, key=str) == sorted([(i, public(t) if t else []) for i, t, _ in rows], key=str)
    assert encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
