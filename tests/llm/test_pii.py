"""Personal data: base spans against the plain patterns, the field against enumeration."""

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relmill.llm import pii, queries

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = [c for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[::-1][0::2]]
        even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
        return 16 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if valid(name, m.group())]


BITS = ["a", "b.c", "@", "@x.y", ".", "..", "1", "25", "255", "256", "007", "4041894974608795", "4111 1111 1111 1111", "-", " ", "+", "+1 (988) 555-2485", "(", ")", "\n", "é", "%", "10.0.0.1"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30))
def test_base_spans(bits):
    text = "".join(bits)
    assert pii.base_spans(text) == plain_spans(text)
    again, added = pii.all_spans(text, np.random.default_rng(1).normal(size=(pii.N_FEATURES, 4)))
    assert again == pii.base_spans(text)
    taken = sorted((a, b) for _, a, b in added)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(taken))
    assert not any(a < y and x < b for _, a, b in added for _, x, y in again)


def test_long_runs_are_linear():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 300_000, "+1 " + "." * 10**6, "a@" * 200_000, "@" * 10**6, "1 " * 10**5):
        pii.base_spans(text)


def cuts(n, segments):
    """All ways to cover n atoms by single atoms outside and segments."""
    if n == 0:
        yield []
        return
    for rest in cuts(n - 1, segments):
        yield rest
    for s, (i, j) in segments:
        if j == n:
            for rest in cuts(i, segments):
                yield [*rest, s]


def test_viterbi_and_forward_match_enumeration():
    rng = np.random.default_rng(4)
    for text in ("a 12-3", "+1 (2) 33", "x@y.z 1"):
        z = pii.Zone(text)
        w = rng.normal(size=(pii.N_FEATURES, 4))
        each = z.x @ w
        segments = list(enumerate(zip(z.i.tolist(), z.j.tolist())))
        ways = list(cuts(z.n, segments))
        both = np.log(np.exp(each).sum(1))
        total = np.log(sum(np.exp(sum(both[s] for s in way)) for way in ways))
        assert abs(pii._forward(z.n, z.i, z.j, both)[-1] - total) < 1e-4
        score = each.max(1) - pii.MARGIN
        best = max(sum(score[s] for s in way) for way in ways)
        got = pii.best_segments(text, w)
        found = sum(score[z.segment(a, b)] for _, a, b in got)
        assert abs(found - best) < 1e-4


def people(n, seed):
    rnd = random.Random(seed)
    words = "river house quiet field open road winter".split()
    out = []
    for i in range(n):
        spans = [f"{rnd.choice(words)}.{rnd.randint(1, 99)}@mail.example.com", ".".join(str(rnd.randint(1, 255)) for _ in range(4)), f"+1 ({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"]
        head = "".join(str(rnd.randint(0, 9)) for _ in range(15))
        spans.append(next(head + str(d) for d in range(10) if pii.luhn(head + str(d))))
        text = " ".join(rnd.choices(words, k=12))
        for s in rnd.sample(spans, rnd.randint(0, 3)):
            text += f" {s} " + " ".join(rnd.choices(words, k=9))
        out.append((i, text + f" in {rnd.randint(1900, 2030)} there were {rnd.randint(10, 900)} of them"))
    return out


def test_field_adds_variants_and_spares_numbers(spark):
    weights = pii.fit(spark.createDataFrame(people(150, 1), SCHEMA))
    for text, kind in (("call me at (415) 555-2671 tonight please", 3), ("call 415-555-2671 tonight please", 3), ("her card 4111.1111.1111.1111 was lost", 2)):
        base, added = pii.all_spans(text, weights)
        assert not base and [k for k, _, _ in added] == [kind], (text, added)
    for text in ("in 1984 there were 300 of them", "version 4.0 of the licence from 2019", "nothing here at all"):
        assert pii.all_spans(text, weights) == ([], [])


def test_long_zones_are_cut_as_one(monkeypatch):
    """Blocks of any size give the cut that the whole zone gives, and lists of numbers lose none at a border."""
    rng = np.random.default_rng(7)
    weights = rng.normal(size=(pii.N_FEATURES, 4)) * 2
    text = " ".join("".join(rng.choice(list("12.-@ a(+)"), size=9)) for _ in range(60))
    whole = pii.best_segments(text, weights)
    assert whole
    for size in (1, 7, 40):
        monkeypatch.setattr(pii, "_BLOCK", size)
        assert pii.best_segments(text, weights) == whole


def test_dense_lists_lose_no_number(spark):
    weights = pii.fit(spark.createDataFrame(people(150, 1), SCHEMA))
    rnd = random.Random(3)
    numbers = [f"{rnd.randint(200, 999)}-{rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}" for _ in range(3000)]
    text = "call " + " or ".join(numbers) + " please"
    assert pii.zones_of(text, []) == [(0, len(text))]
    base, added = pii.all_spans(text, weights)
    assert not base and [text[a:b] for _, a, b in added] == numbers


def test_longest_variant_is_one_segment():
    card = " . ".join(["4111"] * 4 + ["111"])
    assert pii.Zone(card).segment(0, len(card)) is not None


def test_odd_rows(spark):
    weights = pii.fit(spark.createDataFrame(people(60, 1), SCHEMA))
    odd = [(1, None), (2, ""), (3, "é 🙂 x@y.zz"), (3, "é 🙂 x@y.zz"), (None, "10.0.0.1"), (2**60 + 1, "quiet " * 50_000 + "+1 415 555 2671")]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit("q") for c in ("spans", "k0", "_text", "_clean", "base", "c0")})
    got = {(r.doc_id, r.base, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.find(df, weights).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "email:4:10", 1), (None, "ip:0:8", 1), (2**60 + 1, "phone:300000:300015", 1)}
    clean = pii.redact(df, weights)
    assert clean.columns == df.columns
    texts = {(r.doc_id, r.text) for r in clean.collect()}
    assert {(1, None), (2, ""), (3, "é 🙂 <email>"), (None, "<ip>"), (2**60 + 1, "quiet " * 50_000 + "<phone>")} == texts
    assert pii.find(df.where("false"), weights).count() == 0
    assert pii.fit(df.where("false")) is None and pii.find(df, None).count() == 6


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op6_pii"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        spans = plain_spans(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in spans) for n in range(4))
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
