import random
import re
import zlib
from collections import Counter

import pytest

from relmill.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_counts(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [o for o in counts if is_near(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return rows


def words(seed, n):
    rng = random.Random(seed)
    made = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(n)}
    made |= {"prefixedwords" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3))) for _ in range(n)}
    return sorted(made | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "a", "b", "ab", "ÿÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿÿ"})


@pytest.mark.parametrize("limit", [4096, 4, 0])
def test_near_pairs_equal_brute_force(spark, limit):
    made = words(limit, 150)
    df = spark.createDataFrame([(w, 1) for w in made + made[:5] + [None]], "word string, _key int")
    got = [tuple(r) for r in spelling.near_pairs(df, limit).collect()]
    assert len(got) == len(set(got))
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in made for b in made if is_near(a, b)}
    assert all(len(a) < len(b) or (len(a) == len(b) and a < b) for a, b in got)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    counts = {w: rng.choice([2, 3, 20, 35, 400, 9000]) for w in words(9, 150)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), limit=16)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(counts) and got.count() == len(counts)


def test_chain_of_forms(spark):
    counts = {"letters": 100_000, "lettersa": 10_000, "lettersab": 1_000, "lettersabc": 100, "lettersabcd": 10}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r.root for r in got.collect()} == {"letters"}


def test_word_counts_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["Spelling", "variant", "ÉCOLIERS", "short", "naïvement", "×÷×÷×÷×"]) for _ in range(80))) for i in range(40)]
    docs += [(None, "Spelling variant"), (77, None), (78, ""), (78, "12 34"), (79, "z" * 200_000 + " spelling"), (79, "z" * 200_000), (80, "q" * 70_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, word int")
    assert {tuple(r) for r in spelling.word_counts(df).collect()} == set(plain_counts(docs).items())


def test_whole_query_on_the_smallest_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    counts = spelling.word_counts(df)
    assert {r.word: r.n for r in counts.collect()} == plain_counts([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
