"""Top-k search against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relmill.llm import covertree as ct

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v in good:
        if i % every == 0:
            least[i] = min(v, least.get(i, v))
    out = set()
    for q, v in least.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK": 60, "QUERY_BLOCK": 7, "TOGETHER": 2, "LEAF": 4, "CELLS": 5, "SAMPLE": 50}.items():
        monkeypatch.setattr(ct, name, value)


def test_matches_all_products(spark, small):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(4, 6))
    rows = [(i, (centers[i % 4] + 0.1 * rng.normal(size=6)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(5, rows[3][1]), (50, rows[3][1]), (2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, rows[1][1])]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3050, []), (-50, rows[7][1]), (4000, [0.0] * 6)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "dim", "cell", "part", "score", "floor", "query_id")})
    got = ct.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_trees_cover_and_prune(small):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-9, 9, (300, 3)) + 1000 * rng.integers(0, 3, (300, 1)), np.full((90, 3), 7)])
    tree = ct.CoverTree(rows)
    assert sorted(tree.order.tolist()) == list(range(390))
    todo = [tree.root]
    while todo:
        n = todo.pop()
        assert np.sqrt(((tree.points[n.low : n.high] - n.center) ** 2).sum(1)).max() <= n.radius + 1e-9
        assert not n.children or (n.children[0].low, n.children[-1].high) == (n.low, n.high)
        todo += n.children
    seen = []
    keep = ct.Best.offer
    try:
        ct.Best.offer = lambda self, low, s, ids: (seen.append(s.size), keep(self, low, s, ids))[1]
        best = ct.search(ct.CoverTree(rows[:60]), np.arange(60), tree, np.arange(390), np.full(60, -np.inf), 3)
    finally:
        ct.Best.offer = keep
    assert sum(seen) < 0.8 * 60 * 390 and len(best.q) == 180


def test_large_components_stay_exact():
    big = np.array([[2**31, 3], [2**31 + 1, -5], [1, 1]], np.int64)
    best = ct.search(ct.CoverTree(big[:1]), np.array([0]), ct.CoverTree(big), np.arange(3), np.array([-np.inf]), 1)
    assert best.score.tolist() == [2**31 * (2**31 + 1) - 15]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ct.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0])], SCHEMA)
    assert ct.top_k(one, F.col("vec_id") % 50 == 0).count() == 0
