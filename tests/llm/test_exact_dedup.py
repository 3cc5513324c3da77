import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from relmill.llm import exact_dedup

SCHEMA = "doc_id long, text string, source string, _hash int, keep_id string"
ODD = [
    (5, "Same Text"), (9, "same text"), (7, "SAME TEXT"), (1, None), (2, ""), (3, "É"), (4, "é"), (6, " same text"),
    (None, "same text"), (None, "alone"), (None, "ALONE"), (8, "x" * 300_000), (10, "X" * 300_000), (11, "ß\u0000z"),
    (12, "again"), (12, "again"), (13, "same\ntext"),
]
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    found = []
    for i, t in rows:
        t = (t or "").translate(LOWER)
        keep = best((x for x in groups[t] if x is not None), default=None)
        found.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(found, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "k") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("keep, best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("hash_bytes", [16, 1, 0])
def test_groups_equal_brute_force(spark, keep, best, hash_bytes):
    rows = ODD + [(100 + i, f"text {i % 37}") for i in range(400)]
    got = exact_dedup.exact_groups(frame(spark, rows), keep, hash_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, best)


def test_a_group_with_most_rows_and_many_small_ones(spark):
    rows = [(i, "copy") for i in range(3000)] + [(5000 + i, f"own {i // 2}") for i in range(3000)]
    got = exact_dedup.exact_groups(frame(spark, rows), "largest")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, max)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_groups(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_normalised_touches_ascii_letters_only(spark):
    rows = spark.createDataFrame([("ÀÉİ AZ[`",)], "text string").select(exact_dedup.normalised().alias("t"), F.lit(1))
    assert rows.first().t == "ÀÉİ az[`"
