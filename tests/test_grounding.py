"""What is searched in the source, and how often."""

import random

from pyspark.sql import functions as F

from relmill.functions.text import WS, compact
from relmill.operators import relations as M

REL = "doc_id long, relation_ord int, head string, relation string, tail string, evidence string, skill string"


def witnessed(spark, source, rows):
    # an RDD, as a plan over local rows is computed while it is optimized
    rdd = spark.sparkContext.parallelize([(*r, source) for r in rows], 2)
    return M.with_witness(spark.createDataFrame(rdd, REL + ", text string"))


def searches(df):
    """Searches in the whole source that the plan holds."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Contains(source_compact")


def test_split_by_confidence_scores_once(spark):
    rows = [(1, 0, "甲", "位于", "乙", "甲位于乙。", "k"), (1, 1, "x" * 30, "r", "y" * 30, "", "k")]
    high, low = M.split_by_confidence(witnessed(spark, "甲位于乙。", rows))
    # both sides read the same written rows
    assert high.inputFiles() and set(high.inputFiles()) == set(low.inputFiles())
    assert not set(M.WITNESS) & set(high.columns)
    assert [r.relation_ord for r in high.collect()] == [0] and [r.relation_ord for r in low.collect()] == [1]


def chosen(source, head, relation, tail, evidence):
    """The shortest of the three options, the first of equal ones."""
    squeeze = lambda x: "".join(x.split())
    units = [u.strip(" ，。；：,.;") for u in source.replace("！", "。").replace("\n", "。").split("。")]
    both = [u for u in units if u and squeeze(tail) in squeeze(u) and squeeze(head) in squeeze(u)]
    joined = (head + relation + tail).strip()
    options = [evidence.strip()] if squeeze(evidence) and squeeze(evidence) in squeeze(source) else []
    options += [min(both, key=len)] if both and squeeze(head) and squeeze(tail) else []
    options += [joined] if joined and squeeze(joined) in squeeze(source) else []
    return min(options, key=len, default="")


def test_evidence_is_the_shortest_option(spark):
    rng = random.Random(5)
    source = "ab c d。a bcd！ abcd ee\nx ab y cd。c d a b，"
    word = lambda n: "".join(rng.choice("ab cde") for _ in range(rng.randint(1, n)))
    rows = [(1, i, word(3), word(1), word(3), word(7) * rng.randint(0, 1), "k") for i in range(400)]
    out = M.select_evidence(witnessed(spark, source, rows))
    found = {r.relation_ord: r.evidence for r in out.select("relation_ord", "evidence").collect()}
    assert found == {r[1]: chosen(source, *r[2:6]) for r in rows}
    # the evidence and the joined fields are each looked for once
    assert searches(out) == 2


def test_compact_drops_all_white_space(spark):
    text = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x11000))))
    row = spark.createDataFrame([(text,), (" \n",), ("",), (None,)], "t string")
    both = row.select(compact(F.col("t")).alias("a"), F.regexp_replace(F.coalesce("t", F.lit("")), WS + "+", "").alias("b")).collect()
    assert all(r.a == r.b for r in both) and len(both[0].a) < len(text)


def test_cited_relations_need_no_unit_to_be_grounded(spark):
    source = "a b。c d"
    rows = [(1, 0, "a", "r", "b", "a b", "k"), (1, 1, "c", "r", "d", "zz", "k"), (1, 2, "a", "r", "d", "zz", "k"), (1, 3, "a", "r", "d", "d", "k")]
    told = {r.relation_ord: (r._cited, r._unit) for r in M.with_support(witnessed(spark, source, rows)).collect()}
    assert told == {0: (True, None), 1: (False, "c d"), 2: (False, None), 3: (True, None)}
    kept = M.ground_relations(witnessed(spark, source, rows))
    assert sorted(r.relation_ord for r in kept.collect()) == [0, 1, 3]
    free = M.ground_relations(M.without_witness(spark.createDataFrame(rows, REL)))
    assert free.count() == 4


def test_dropped_relations_have_no_evidence_chosen(spark):
    source = "甲旅位于乙区。丙团"
    rows = [(1, 0, "甲旅", "位于", "乙区", "甲旅位于乙区", "k"), (1, 1, "甲旅", "位于", "丙团", "zz", "k"), (1, 2, "甲旅", "位于", "乙区", "a", "odd")]
    kept, dropped = M.sanitize_relations(witnessed(spark, source, rows), ["k"])
    assert [(r.relation_ord, r.evidence) for r in kept.collect()] == [(0, "甲旅位于乙区")]
    assert sorted((r.relation_ord, r.evidence, r.reason) for r in dropped.collect()) == [(1, "zz", "not grounded"), (2, "a", "unknown skill")]
    # only the cited evidence is looked for
    assert searches(dropped) == 1


def test_names_are_looked_for_in_the_words_of_the_text(spark):
    """The same answer as a search of the whole text, for names across blanks, tabs and line ends too."""
    texts = ["", " ", "ab cd\nef", "ab  cd", "ab\tcd ef", "x；y z", " lead ab", "中文 ab中"]
    names = ["", " ", "ab", "b c", "ab cd", "cd\nef", "b\tc", "ab\tcd", "d ef", "；y", "y z", "ab ", " ab", "  ", "中", "文 a", "xab", "d\nx"]
    units = M.with_witness(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    pairs = units.crossJoin(spark.createDataFrame([(n,) for n in names], "name string"))
    doc = F.coalesce("text", F.lit(""))
    found = pairs.select("text", "name", M._held(doc, F.col("source_words"), F.col("name")).alias("held")).collect()
    assert len(found) == (len(texts) + 1) * len(names)
    for r in found:
        assert r.held == bool(r.text and r.name and r.name in r.text), r
    repeated = M.with_witness(spark.createDataFrame([("the same words " * 50,)], "text string")).first()
    assert repeated.source_words.split(" ") == ["the", "same", "words", ""]
