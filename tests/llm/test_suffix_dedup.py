"""Repeated bytes against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relmill.llm import queries
from relmill.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string"


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(r)))
        out.append((len(r), sum(gone), spans, bytes(c for c, g in zip(r, gone) if not g)))
    return out


def check(spark, texts, **sizes):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    df = sd.stored(df)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(df, **sizes).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, sizes.get("length", sd.LENGTH))


def test_random_overlaps(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choices("abcdé ", k=n))
    passages = [word(rnd.randint(25, 150)) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [word(rnd.randint(0, 40)) if rnd.random() < 0.5 else rnd.choice(passages) for _ in range(rnd.randint(0, 6))]
        for i, p in enumerate(parts):
            if rnd.random() < 0.4 and p:
                a, b = sorted((rnd.randrange(len(p) + 1), rnd.randrange(len(p) + 1)))
                parts[i] = p[a:b]
        texts.append("".join(parts))
    check(spark, texts + [None, "", "x", texts[0]], length=24, gram=9, cell=4)


def test_runs_of_one_letter_and_periods(spark):
    texts = ["a" * 100, "a" * 23, "a" * 24 + "b", "ab" * 40, "b" + "ab" * 13, "abc" * 9, "xyz" * 9 + "q", "é" * 40]
    check(spark, texts, length=24, gram=9, cell=4)
    check(spark, ["a" * 25], length=24, gram=9, cell=5)
    check(spark, ["a" * 24], length=24, gram=9, cell=9)


def test_chunks(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 64)
    rnd = random.Random(4)
    passage = "".join(rnd.choices("abcdef", k=300))
    check(spark, ["u" + passage, passage[7:200] + "w", passage[3:]], length=24, gram=9, cell=4)


def test_production_sizes(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choices("etaoin shrdlu", k=n))
    p, q = word(900), word(399)
    texts = [word(500) + p + word(50), p[200:] + word(700), q + word(10), word(5) + q, p[:400], p[1:401] + p[:399], word(450)] + [word(300) + p[100:720] + word(30) for _ in range(20)]
    check(spark, texts + [texts[0], None])


def test_every_start_is_in_one_run():
    rng = np.random.default_rng(5)
    for text in (b"abc" * 50, b"a" * 200, bytes(rng.integers(0, 3, 500, dtype=np.uint8)), b"ab", b""):
        parts = sd.runs(text, 24, 9)
        starts = [i for p in parts for a, b in zip(p[2], p[3]) for i in range(a, b + 1)]
        assert starts == list(range(max(0, len(text) - 23)))
        for p in parts:
            for a, b, at in zip(p[2], p[3], p[4]):
                assert b <= at < a + 16


def test_odd_rows(spark):
    odd = [(None, "z" * 500), (5, "z" * 500), (5, "z" * 500), (2**60 + 1, "short")]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit(1) for c in ("_row", "kept", "low", "bucket", "at", "n")})
    got = sorted((str(r.doc_id), r.n_removed) for r in sd.remove_repeats(df).collect())
    assert got == [("1152921504606846977", 0), ("5", 500), ("5", 500), ("None", 500)]
    assert sd.remove_repeats(df.where("false")).count() == 0


def test_rows_that_repeat_without_an_id(spark):
    """They share a name, and the result is that of any other copies."""
    p, q = "".join(map(str, range(200))), "".join(map(str, range(900, 1200)))
    texts = [p + q, p + q, p + "x" + q[:300], q[:410] + "y", None, None, "", ""]
    df = spark.createDataFrame([(None, t) for t in texts], SCHEMA)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(df).collect())
    assert got == sorted(plain(texts, 400))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((d.doc_id for d in docs), plain([d.text for d in docs], 400)))
    for r in queries.QUERIES["op7_suffix_dedup"](spark, sf).collect():
        n, removed, spans, kept = want.pop(r.doc_id)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    assert not want


def test_split_of_the_scan_may_change_between_jobs(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choices("etaoin shrdlu", k=n))
    p = word(600)
    texts = [word(700) if i % 3 else word(50) + p + word(i) for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(6).write.parquet(f"{tmp_path}/docs")
    name = "spark.sql.files.openCostInBytes"
    was, store, sizes = spark.conf.get(name), sd.stored, iter([1 << 30, 1, 1 << 22] * 20)

    def resplit(df):
        out = store(df)
        spark.conf.set(name, str(next(sizes)))
        return out

    monkeypatch.setattr(sd, "stored", resplit)
    try:
        df = spark.read.parquet(f"{tmp_path}/docs")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(df).collect()}
    finally:
        spark.conf.set(name, was)
    assert [got[i] for i in range(len(texts))] == plain(texts, 400)
