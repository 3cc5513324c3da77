"""BPE by halves against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from relmill.llm import bpe, queries

PATH = bpe.default_path()
WHOLE = Tokenizer.from_file(PATH)
C = bpe.codec(PATH)
BITS = ["a", "aa", "ab", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "!", "...", "é", "ß", "漢字", "語", "🙂", "　",
        "<|endoftext|>", "<|", "token", "ization", "AAAA", "_", "​", "\x1c", "\r\n", "x'", "''"]


def want(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=60), st.integers(1, 40))
def test_tree_equals_whole(bits, most):
    text = "".join(bits)
    assert bpe.encode_tree(C, text, most).tolist() == want(text)
    assert C.encode(text).tolist() == want(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.integers(1, 60))
def test_tree_equals_whole_on_any_text(text, most):
    assert bpe.encode_tree(C, text, most).tolist() == want(text)
    assert C.encode(text).tolist() == want(text)


@pytest.mark.parametrize("text", ["a" * 5003, "ab" * 3001, " " * 3000 + "x", "\n" * 999, "!" * 2777, "0" * 3001, "語" * 1500, "é" * 2001, "'s" * 900, "ihttps" * 700])
def test_long_unsplit_text(text):
    for most in (7, 64, 1000):
        assert bpe.encode_tree(C, text, most).tolist() == want(text)


def test_random_letters_without_spaces():
    rnd = random.Random(5)
    for n in (100, 1000, 20000):
        text = "".join(rnd.choices("etaoinshrdlu", k=n))
        assert bpe.encode_tree(C, text, 50).tolist() == want(text)


def test_documents(spark):
    rnd = random.Random(1)
    words = ["the", "ation", "é", "12", "don't", "\n", "  ", "<|endoftext|>"]
    long = " ".join(rnd.choices(words, k=3000))
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, long), (4, long), (None, "x" * 3000), (6, " a  b \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _row", "2 AS ids", "3 AS piece")
    out = bpe.decode(bpe.encode(df, long=500)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(d), t or "") for d, t in rows)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == want(r.text) and r.n_tokens == len(want(r.text))
    assert bpe.encode(df.where("false")).count() == 0


def test_decode_bad_ids(spark):
    ids = np.array([C.encode("語")[0], 99999], "<u4").tobytes()
    df = spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids binary")
    assert [r.text for r in bpe.decode(df).orderBy("doc_id").collect()] == [WHOLE.decode([int(C.encode("語")[0])], skip_special_tokens=False), None]


def test_query(spark, sf):
    out = {r.doc_id: r for r in queries.QUERIES["op2_bpe_round_trip"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = want(d.text or "")
        r = out[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_stretches_are_kept_as_bytes():
    """Ids of a text are joined from bytes, not gathered one by one; letters beyond ASCII come by their bytes."""
    of = bpe.Codec(bpe.default_path())
    for text in ("the", "naïve", "你好", "word,"):
        for pieces, before in ((of.heads, ""), (of.words, " ")):
            ids = of.tok.encode(before + text, add_special_tokens=False).ids
            assert pieces[text] == np.array(ids, "<u4").tobytes()
