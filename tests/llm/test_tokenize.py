import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm.tokenize import VOCABULARY, BpeTransducer, StreamingEncoder, TextDecoder, Vocabulary, decode, encode, encode_text

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def v():
    return Vocabulary.load()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefghijk éß語жthe", min_size=1, max_size=200).map(lambda s: s.replace(" ", "")).filter(bool), st.integers(1, 40), st.integers(1, 60))
def test_transducer_equals_whole_merge(v, word, step, every):
    machine, data, out = BpeTransducer(v, every), word.encode(), []
    for i in range(0, len(data), step):
        out += machine.feed(data[i : i + step])
        assert len(machine.last) <= every + 2 * v.lookahead + step
    out += machine.finish()
    assert out == list(v.engine._encode_single_piece(word))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400), st.integers(1, 50))
def test_streaming_equals_whole(v, text, chunk):
    stream, out = StreamingEncoder(v, 16), []
    for i in range(0, len(text), chunk):
        out += stream.feed(text[i : i + chunk])
    assert out + stream.finish() == v.engine.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(v, text):
    machine = TextDecoder(v)
    assert "".join(map(machine.feed, encode_text(text, v))) + machine.finish() == text


def test_same_as_the_json_vocabulary(v):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("Hello  world\n\n x", "<|endoftext|> as text", "it's 12,345 été ﬁ ​﻿", " \t\n ", "é"):
        assert other.encode(text, add_special_tokens=False).ids == encode_text(text, v)


def test_encode_documents(spark, v):
    long = "word " * 40_000 + "x" * 150_000
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "<|endoftext|>"), (5, long), (5, long), (None, "a")]
    docs = spark.createDataFrame([(k, t, 0, "n") for k, t in rows], "doc_id bigint, text string, ids int, tokens string")
    got = encode(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    ids = [(r.doc_id, r.ids) for r in got.collect()]
    assert sorted(ids, key=str) == sorted(((k, v.engine.encode_ordinary(t) if t else []) for k, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in decode(got).collect()), key=str) == sorted(((k, t or "") for k, t in rows), key=str)
    assert encode(docs.limit(0)).count() == 0
