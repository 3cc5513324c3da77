"""Toxicity: held-out accuracy, located sentences, and input of every shape."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from relmill.llm import queries, toxicity

SCHEMA = "doc_id long, text string"
NICE = "the river runs past green fields and quiet houses where people read".split()
NASTY = ["blork", "zorgish", "zorgous"]


def rows(n, seed=0):
    rnd = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        sentences = [" ".join(rnd.choices(NICE, k=rnd.randint(3, 9))) for _ in range(rnd.randint(1, 8))]
        bad = rnd.random() < 0.4
        if bad:
            at = rnd.randrange(len(sentences))
            sentences[at] += " " + rnd.choice(NASTY)
        out.append((i, ". ".join(sentences) + ".\nThe end"))
        labels.append((i, int(bad)))
    return out, labels


def model_of(spark, n=200):
    docs, labels = rows(n)
    return toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), steps=120)


def test_new_documents(spark):
    model = model_of(spark)
    docs, labels = rows(100, seed=9)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, SCHEMA), model).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    found = toxicity.offending_sentences(spark.createDataFrame(docs, SCHEMA), model).collect()
    assert {r.doc_id for r in found} == {i for i, y in labels if y}
    texts = dict(docs)
    for r in found:
        assert any(w in r.sentence for w in NASTY) and texts[r.doc_id][r.start : r.end] == r.sentence
        assert (got[r.doc_id].worst_start, got[r.doc_id].worst_end) == (r.start, r.end)


def test_noisy_or():
    logits, none = [0.3, -2.0, 1.1, -4.0, -4.0], 1 / (1 + math.exp(4.0))
    want = 1 - math.prod(1 - (1 / (1 + math.exp(-z)) - none) / (1 - none) for z in logits)
    assert abs(toxicity.noisy_or(np.array(logits), -4.0) - want) < 1e-12


def test_odd_rows(spark):
    model = model_of(spark)
    odd = [(1, None), (2, ""), (3, " \n\n "), (4, "blork"), (4, "blork"), (None, "blork."), (2**60 + 1, "x" * 200_000), (6, "the river. " * 50_000)]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "k0", "_text", "_toxic", "predicted")})
    got = [(r.doc_id, r.predicted, r.score) for r in toxicity.score(df, model).collect()]
    assert sorted((str(d), p) for d, p, _ in got) == sorted((str(d), int("blork" in (t or ""))) for d, t in odd)
    assert all(s == 0 for d, _, s in got if d in (1, 2, 3)) and all(0 <= s <= 1 for _, _, s in got)
    assert toxicity.score(df.where("false"), model).count() == 0


def test_nothing_to_learn(spark):
    docs, labels = rows(10)
    docs, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) == toxicity.EMPTY
    clean = spark.createDataFrame([(i, 0) for i, _ in labels] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, clean) == toxicity.EMPTY
    assert {r.predicted for r in toxicity.score(docs, toxicity.EMPTY).collect()} == {0}


def test_query(spark):
    out = queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = out.join(labels, "doc_id").where("held_out").collect()
    wrong = sum(r.toxic != r.predicted for r in held)
    assert len(held) > 50 and wrong <= 0.1 * len(held)
