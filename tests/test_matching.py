"""Paragraphs that support a relation, against a Python model."""

import random
import re

from relmill.operators import provenance as P

PARAGRAPH = "struct<page:int,global_block_id:int,bbox:array<double>,content:string>"
SECTION = f"struct<section_id:string,text:string,page_start:int,page_end:int,paragraphs:array<{PARAGRAPH}>>"
BATCH = f"doc_id long, batch_index int, section_ids array<string>, block_ids array<int>, sections array<{SECTION}>, relations array<struct<head:string,tail:string,evidence:string>>"


def test_a_section_is_searched_once(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc d") for _ in range(rng.randint(0, n)))
    sections = []
    for k in range(5):
        paragraphs = [word(12) for _ in range(4)]
        # the last section's text is not that of its paragraphs
        text = "\n".join(paragraphs) if k < 4 else "abcabc"
        sections.append((f"s{k}", text, 1, 2, [(1, 10 * k + i, [0.0], p) for i, p in enumerate(paragraphs)]))
    relations = [(word(3), word(3), word(5)) for _ in range(200)]
    rows = spark.sparkContext.parallelize([(1, 0, ["s0"], [1], sections, relations)], 1)
    out = P.match_paragraphs(spark.createDataFrame(rows, BATCH))

    squeeze = lambda x: "".join(x.split())
    expected = []
    for r, (head, tail, evidence) in enumerate(relations):
        h, t, e = head.strip(), tail.strip(), squeeze(evidence)
        for _, text, _, _, paragraphs in sections:
            for _, block, _, p in paragraphs:
                one, both = h in p or t in p, h and t and h in p and t in p
                if (e and e in squeeze(p)) or both or (e and e in squeeze(text) and one):
                    expected.append((r, block))
    assert sorted((r.relation_ord, r.global_block_id) for r in out.collect()) == sorted(expected)
    # for a paragraph: its own text for the evidence, and head and tail twice; the section is not searched again
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    tests = [body for body in re.findall(r"filter\(.*?, false\)", plan, re.S) if "Contains(" in body]
    assert tests and all(body.count("Contains(") == 5 for body in tests)
