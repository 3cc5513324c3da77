import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from relmill.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _key int, pos int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests):
    """The root, and the (left, right) steps of every leaf."""
    paths, under, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        above, covers = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for i in range(len(run)):
                for place in under[at + i]:
                    paths[place].append(("".join(run[:i]), "".join(run[i + 1 :])))
            above.append(digest(*run))
            covers.append(sum(under[at : at + 3], []))
        nodes, under = above, covers
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, witness) of (doc_id, source, lang, n_chars, text) rows."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0], plain_leaf(r)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([d for _, d in sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    found = []
    for s, top in zip(order, tops):
        leaves = sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        found += [(i, d, trees[s][0], root, path + top) for (i, d), path in zip(leaves, trees[s][1])]
    return sorted(found, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def result(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.witness]) for r in df.collect()), key=str)


def made(n, source="hot", first=0):
    return [(first + i, source, "en", i, f"text {i}\nline") for i in range(n)]


ODD = [
    (1, None, None, None, None), (2, "", "", 0, ""), (None, "", "en", 1, "x"), (3, "é", "fr", 2, "é\nß"), (4, "é", None, 3, "z" * 200_000),
    (5, "z", "en", 4, "same"), (5, "z", "en", 4, "same"), (6, "Z", "en", 4, "a"), (6, "\U0001f600", "en", 4, "a"), (6, "￮", "en", 4, "a"),
]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 729, 730, 1458, 1600])
def test_equals_brute_force(spark, n):
    rows = ODD + made(n)
    assert result(manifest.witnesses(manifest.append(frame(spark, rows)))) == plain(rows)


@pytest.mark.parametrize("height", [1, 2])
def test_deeper_tiers_and_many_sources(spark, height):
    rows = made(100) + [(i, f"s{i}", "en", 1, "t") for i in range(30)]
    assert result(manifest.witnesses(manifest.append(frame(spark, rows), height=height), height=height)) == plain(rows)


def test_appends_equal_one_build(spark):
    parts = [made(700) + made(3, "b"), made(100, first=700) + made(1, "c"), made(2000, first=800) + made(40, "b", 3)]
    blocks = None
    for part in parts:
        blocks = manifest.append(frame(spark, part), blocks)
    assert result(manifest.witnesses(blocks)) == plain(sum(parts, []))
    full = blocks.where(F.size("items") == 729)
    assert full.count() == 2800 // 729 and blocks.where("block < 0").isEmpty()


def test_late_documents_are_refused(spark):
    blocks = manifest.append(frame(spark, made(5, first=10)))
    for late in ([(14, "hot", "en", 1, "t")], [(None, "hot", "en", 1, "t")]):
        with pytest.raises(ValueError, match="late"):
            manifest.append(frame(spark, late), blocks)
    assert manifest.append(frame(spark, []), blocks).count() == blocks.count()


def test_proof_and_fold(spark):
    rows = made(40) + made(2, "b")
    df = manifest.append(frame(spark, rows), carry={"shown": F.when(F.col("doc_id") % 2 == 0, F.lit("0" * 64)).otherwise(manifest.leaf())})
    got = manifest.witnesses(df, ["shown"]).select("*", manifest.proof().alias("p"), manifest.folded("shown").alias("f"))
    assert got.where("f = root").count() == got.where("doc_id % 2 = 1").count() == 21
    for r in got.collect():
        assert r.p == digest(*(a + b for a, b in r.witness))
        up = r.shown
        for a, b in r.witness:
            up = digest(a, up, b)
        assert up == r.f


def test_empty_table(spark):
    assert manifest.witnesses(manifest.append(frame(spark, []))).collect() == []


def test_one_document(spark):
    row = manifest.witnesses(manifest.append(frame(spark, made(1)))).first()
    assert row.witness == [] and row.leaf == row.subroot == row.root
