"""Importance resampling against a plain count of n-grams, and the sampler's distribution."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relmill.llm import quality, queries

SCHEMA = "doc_id long, text string"


def docs(n=80):
    rnd = random.Random(1)
    good, bad = "clear sound prose with care".split(), "junk spam buy now click".split()
    return [(i, " ".join(rnd.choices(good if i % 2 else bad, k=rnd.randint(5, 30)))) for i in range(n)]


def test_weights_match_plain_counts(spark):
    rows = docs()
    df, target = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1,), (3,), (5,), (5,), (None,)], "doc_id long")
    raw, good = Counter(), Counter()
    for i, t in rows:
        found = quality.grams(t).tolist()
        raw.update(found)
        if i in (1, 3, 5):
            good.update(found)
    def log(counts, g):
        return math.log((counts[g] + quality.SMOOTHING) / (sum(counts.values()) + quality.SMOOTHING * quality.BUCKETS))
    got = {r.doc_id: r for r in quality.weigh(df, quality.fit(df, target)).collect()}
    for i, t in rows:
        want = sum(log(good, g) - log(raw, g) for g in quality.grams(t).tolist())
        assert abs(got[i].log_weight - want) < 1e-6 and got[i].n_grams == 2 * len(t.split()) - 1
    chosen = {r.doc_id for r in quality.select_by_importance(df, target).where("selected").collect()}
    assert len(chosen) == 40 and sum(i % 2 for i in chosen) > 35


def test_sampling_follows_the_weights(spark):
    weights = {1: 1.0, 2: 2.0, 3: 5.0}
    df = spark.range(1).selectExpr("explode(sequence(1, 3000)) AS seed").crossJoin(spark.createDataFrame(list(weights.items()), "doc_id long, w double"))
    noise = F.expr("-ln(-ln((shiftrightunsigned(xxhash64(doc_id, seed), 11) + 0.5) / 9007199254740992.0))")
    first = df.withColumn("key", F.log("w") + noise).groupBy("seed").agg(F.max_by("doc_id", "key").alias("d")).groupBy("d").count().collect()
    for r in first:
        assert abs(r["count"] / 3000 - weights[r.d] / 8) < 0.04


@pytest.mark.parametrize("keys", [[1.0] * 9, list(range(50)), [0.1, 0.1, 0.2, -5.0, 1e9], [-3.0], [float(np.nextafter(1, 2)), 1.0, 1.0]])
def test_exactly_k(spark, keys):
    rows = [(i if i % 5 else None if i else 0, float(k)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    for k in {0, 1, len(keys) // 2, len(keys) - 1, len(keys), len(keys) + 3}:
        got = quality.resample(df, k).where("selected").collect()
        assert len(got) == min(k, len(keys)) or sum(d is None for d, _ in rows) > 1
        worst = min((r.key for r in got), default=math.inf)
        assert sum(x > worst for x in keys) <= k


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (None, "c"), (2**60 + 1, "x " * 100_000)]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "log_weight", "selected", "bucket", "n")})
    got = quality.select_by_importance(df, df.where("doc_id = 3"))
    assert got.columns == ["doc_id", "n_grams", "log_weight", "key", "selected"] and got.count() == 7
    assert {(r.doc_id, r.n_grams) for r in got.collect()} == {(1, 0), (2, 0), (3, 3), (None, 1), (2**60 + 1, 199_999)}
    assert quality.select_by_importance(df.where("false"), df).count() == 0
    assert {r.log_weight for r in quality.select_by_importance(df, df.where("false")).collect()} == {0.0}


def test_query(spark, sf):
    out = queries.QUERIES["op8_importance_resampling"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.count() == n and out.where("selected").count() == n // 2
