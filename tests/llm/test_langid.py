"""Language identification: held-out accuracy, mixtures, empty and odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from relmill.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"en": "the and of that this which house with there", "de": "der und die nicht schule straße über zwischen", "fr": "le et de que nous vous être école français"}


def text(lang, n, rnd):
    return " ".join(rnd.choices(WORDS[lang].split(), k=n))


def docs(spark, n=60):
    rnd = random.Random(2)
    rows = [(i, text(lang, rnd.randint(20, 60), rnd), lang) for i in range(n) for lang in [sorted(WORDS)[i % 3]]]
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_follow_the_text(spark):
    model = langid.fit(docs(spark))
    rnd = random.Random(3)
    rows = [(i, text("en", 100 - i, rnd) + " " + text("de", i, rnd), None) for i in (0, 30, 50, 70)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got[0].langs == ["en"] and got[30].lang_pred == "en" and got[70].lang_pred == "de"
    for i in (30, 50, 70):
        assert set(got[i].langs) == {"en", "de"}
        assert abs(dict(zip(got[i].langs, got[i].shares))["de"] - i / 100) < 0.15


def test_likelihood_never_falls():
    rng = np.random.default_rng(0)
    p = rng.random((50, 3)).astype(np.float32)
    n = rng.integers(1, 9, 50).astype(np.float32)
    at, of = np.array([0, 20]), np.repeat([0, 1], [20, 30])
    fits = [langid._shares(p, n, at, of, np.full((2, 3), 1 / 3, np.float32), r)[1] for r in range(1, 8)]
    assert (np.diff(fits, axis=0) > -1e-3).all()


def test_odd_rows(spark):
    df = docs(spark).unionByName(
        spark.createDataFrame([(901, None, "en"), (902, "", "en"), (903, "12 !? #", "de"), (904, "x" * 100_000, None), (None, "the house and", None), (2**60 + 1, "schule", None)], SCHEMA)
    )
    df = df.unionByName(df).withColumns({"lang_pred": F.lit("zz"), "k0": F.lit(1), "_text": F.lit("q"), "score": F.lit(7)})
    model = langid.fit(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, model).collect()]
    assert len(got) == 2 * 66
    by = {d: (p, s) for d, p, s in got}
    assert by[901] == by[902] == by[903] == ("und", 0.0) and by[904][0] in WORDS and by[None][0] == "en" and by[2**60 + 1][0] == "de"
    assert all(0 <= s <= 1 for _, _, s in got)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d in by if d not in (901, 902, 903)}


def test_nothing_learned(spark):
    none = docs(spark).where("false")
    assert langid.fit(none) == {} and langid.identify(none, {}).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark), {}).collect()} == {"und"}


def test_query_held_out(spark, sf):
    out = queries.QUERIES["op4_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows) > 0
    assert out.count() == truth.count()
