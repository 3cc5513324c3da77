"""SimHash near-duplicates against a pairwise comparison."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relmill.llm import simhash
from relmill.llm.components import components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (d, _), g in zip(prints, group):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    return sorted((str(d), f"{p:016x}", low.get(g)) for (d, p), g in zip(prints, group))


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            words = rnd.choice(out).split()
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 300))))
    return out


def test_matches_brute_force(spark):
    rows = [(100 - i, t) for i, t in enumerate(texts(1, 90))]
    rows += [(7, None), (500, ""), (501, " \n\t"), (3, "Ä b"), (3, "Ä b"), (None, "a B c"), (9, "a b C"), (10, "é " * 5000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == plain_components(rows)


def test_tiles_lose_no_link(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(-(2**63), 2**63 - 1, 60)
    prints = {int(x) for x in base}
    for x in base:
        for _ in range(5):
            flips = rnd.choice(64, rnd.integers(1, 4), replace=False)
            y = int(np.uint64(x.view(np.uint64)) ^ np.uint64(sum(1 << int(f) for f in flips)))
            prints.add(y - 2**64 if y >= 2**63 else y)
    prints |= {0, -1, 1, 3, 7}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components(simhash.fingerprint_links(df, 2, tile=20)).collect()}
    order = sorted(prints)
    group = {p: p for p in order}
    for i, a in enumerate(order):
        for b in order[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {p: new if g == old else g for p, g in group.items()}
    assert {p: got.get(p, p) for p in order} == group


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(9, 3), (3, 9), (None, 2)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    group = {x: x for l in links for x in l if None not in l}
    for _ in links:
        for a, b in links:
            if a is not None and b is not None:
                group[a] = group[b] = min(group[a], group[b])
    linked = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    assert got == {x: group[x] for x in linked if group[x] != x}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], SCHEMA)
    df = df.withColumns({c: F.lit("x") for c in ("fp", "_fp", "_row", "cell", "component_id", "a", "root")})
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(1, 1), (2, 1)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns or set(kept.columns) == set(df.columns)
    assert [r.doc_id for r in kept.collect()] == [1]
