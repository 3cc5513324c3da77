"""Decontamination against a plain alignment of templates."""

import random
import re

from pyspark.sql import functions as F

from relmill.llm import decontaminate as dec
from relmill.llm import queries

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_words(text, item):
    """(word without case, kind or None, whether the word may be a name or not) of a text or item."""
    out, start = [], True
    for w in text.split():
        core = re.sub(r"^\W+|\W+$", "", w.lower()) or w
        plain = re.sub(r"^[^\w+-]+|[^\w%°]+$", "", w)
        name = len(plain) > 1 and plain[0].isupper() and plain[1:].islower()
        if re.fullmatch(r"[+-]?\d+([.,:/]\d+)*", plain) or re.fullmatch(r"[+-]?\d+([.,]\d+)*([^\W\d_]+|%)", plain):
            kind, name = "#", False
        elif plain.lower() in dec.UNITS:
            kind, name = "unit", False
        else:
            kind = "name" if name and not start else None
        out.append((core, kind, name and start))
        start = w[-1] in ".!?:"
    if item:
        names = {core for core, kind, _ in out if kind == "name"}
        out = [(core, "name" if free and core in names else kind, False) for core, kind, free in out]
    return out


def plain_matches(doc, item, window=5, coverage=0.8):
    a, b = plain_words(doc, False), plain_words(item, True)
    if not a or not b:
        return False
    if len(b) < window:
        if len(a) != len(b):
            return False
        window = len(b)
    n = len(b) - window + 1
    hits = []  # (shift, item position, equal as written, item values to document values)
    for i in range(len(a) - window + 1):
        for j in range(n):
            x, y = a[i : i + window], b[j : j + window]
            values = {((k, v), (k, u)) for (u, _, _), (v, k, _) in zip(x, y) if k}
            slots = sum(k is not None for _, k, _ in y)
            if all(u == v for (u, _, _), (v, _, _) in zip(x, y)):
                hits.append((i - j, j, True, {(p, p) for p, _ in values}))
            elif slots and window - slots >= 2 and all(
                (k is not None and (l == k or (free and k == "name"))) or (k is None and l is None and u == v)
                for (u, l, free), (v, k, _) in zip(x, y)
            ):
                hits.append((i - j, j, all(p == q for p, q in values), values))
    size = {s: sum(h[0] == s for h in hits) for s in {h[0] for h in hits}}
    places, last = [], None
    for s in sorted(size):
        if last is None or s - last > n:
            places.append([])
        places[-1] += [h for h in hits if h[0] == s]
        last = s
    for place in places:
        best = {}
        for s, j, same, values in place:
            best[j] = min(best.get(j, (2, 0, 0, None)), (not same, -size[s], s, frozenset(values)), key=lambda x: x[:3])
        pairs = set().union(*(v for *_, v in best.values()))
        torn = {p for p, q in pairs for p2, q2 in pairs if p == p2 and q != q2}
        if sum(not changed or not any(p in torn for p, _ in v) for changed, _, _, v in best.values()) >= coverage * n:
            return True
    return False


ITEM = "A train leaves with 120 people and meets Anna after 3 hours near Paris while 120 people wait for the second train to come"
OTHER = "A train leaves with 75 people and meets Boris after 9 days near Rome while 75 people wait for the second train to come"
WRONG = "A train leaves with 75 people and meets Boris after 9 days near Rome while 64 people wait for the second train to come"


def test_reparameterised(spark):
    rnd = random.Random(1)
    words = "the of and people train river second green wait near".split()
    fill = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [(1, f"{fill(40)} {ITEM} {fill(30)}"), (2, f"{fill(3)} {OTHER}"), (3, f"{fill(9)} {WRONG} {fill(9)}"), (4, fill(400)), (5, ITEM.lower()), (6, " ".join(ITEM.split()[:12])),
            (7, None), (8, ""), (9, "yes"), (9, "yes"), (None, OTHER), (2**60 + 1, "x " * 50_000 + ITEM), (11, "1 2 3 4 5 6 7 8 9 10 11 12")]
    items = [(10, ITEM), (11, ITEM), (12, "yes"), (13, None), (14, ""), (15, "9 8 7 6 5 4 3 2 1 0 9 8"), (16, "the second train near the river")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("_row", "id", "hash", "item_id", "slots")})
    bench = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit(1) for c in ("doc_id", "id", "n")})
    got = [(str(r.doc_id), r.item_id, r.reparameterised) for r in dec.contaminated(docs, bench).collect()]
    want = [(str(d), i) for d, t in rows for i, x in items if i != 11 and plain_matches(t or "", x or "")]
    assert sorted((d, i) for d, i, _ in got) == sorted(want)
    assert ("1", 10, False) in got and ("2", 10, True) in got and ("None", 10, True) in got
    assert ("5", 10, False) in got
    assert not {d for d, _, _ in got} & {"3", "4", "6", "7", "8", "11"}
    assert [d for d, i, _ in got if i == 12] == ["9", "9"]
    clean = dec.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if str(d) not in {x for x, _, _ in got})


def test_random_against_plain(spark):
    rnd = random.Random(7)
    vocabulary = "the of and Paris Rome 12 7 kg hours is. so".split()
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 14)))) for i in range(12)]
    rows = []
    for d in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 12)) + rnd.choice(items)[1].split() + rnd.choices(vocabulary, k=rnd.randint(0, 12))
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((d, " ".join(words)))
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    low = {}
    for i, t in items:
        low.setdefault(t, i)
    assert got == {(d, i) for d, t in rows for x, i in low.items() if plain_matches(t, x)}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, ITEM)], DOCS), spark.createDataFrame([(1, ITEM)], ITEMS)
    assert dec.contaminated(docs.where("false"), bench).count() == 0
    assert dec.contaminated(docs, bench.where("false")).count() == 0
    assert dec.decontaminate(docs, bench.where("false")).count() == 1


def test_query_finds_verbatim_items(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id for r in queries.QUERIES["op3_decontamination"](spark, sf).collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    verbatim = {d.doc_id for d in docs if any(i in d.text for i in items)}
    assert verbatim and verbatim <= found and len(found - verbatim) <= 1


LONG = "A shop sells 120 red apples and then it packs all of them in boxes of wood that stand on a long table by the door where every one of the people who come in can see them and take some home until at the end of this day all 120 are gone"


def test_one_edited_value_costs_only_its_windows(spark):
    edited = LONG.replace("all 120", "all 121")
    three = "Here 3 boxes hold what other people put in 5 bags so that both of them carry the same load of apples"
    rows = [(1, edited), (2, three.replace("3", "4").replace("5", "4")), (3, LONG.replace("sells 120", "sells 7").replace("all 120", "all 8")), (4, WRONG)]
    items = [(10, LONG), (11, three), (12, ITEM)]
    found = {(r.doc_id, r.item_id): r for r in dec.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    n = len(LONG.split()) - 4
    last = [i for i, w in enumerate(LONG.split()) if w == "120"][-1]
    touched = len([i for i in range(n) if i <= last < i + 5])
    assert set(found) == {(1, 10), (2, 11)} | ({(3, 10)} if n - 5 - touched >= 0.8 * n else set())
    assert found[1, 10].n_matched == n - touched and not found[1, 10].reparameterised
    assert found[2, 11].coverage == 1.0 and found[2, 11].reparameterised


def test_case_and_names_at_the_start_of_sentences(spark):
    tom = "Tom buys 12 pears at the market. Tom sells 5 of them to his aunt. Tom gives the rest to old Tom who eats 3 of them."
    anna = tom.replace("Tom", "Anna").replace("12", "14")
    torn = anna.replace("Anna sells", "Boris sells").replace("Anna gives", "Carla gives")
    rows = [(1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.title()), (4, f"Some text. {anna} The end."), (5, torn), (6, tom.lower()), (7, OTHER.replace("wait", "sit"))]
    items = [(10, ITEM), (11, tom)]
    got = {(r.doc_id, r.item_id): (r.coverage, r.reparameterised) for r in dec.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, 10): (1.0, False), (2, 10): (1.0, False), (3, 10): (1.0, False), (4, 11): (1.0, True), (6, 11): (1.0, False)}


def test_values_hold_over_an_inserted_word(spark):
    item = "A shop sells 120 red apples and packs them in boxes of wood then it sells 120 green pears that stand on the long table by the door"
    torn = item.replace("120 red", "75 red").replace("120 green", "64 green")
    rows = [(1, torn), (2, torn.replace("then it", "then very it")), (3, item.replace("120", "75").replace("then it", "then very it")),
            (4, f"{item.replace('120', '75')} {item.replace('120', '64')}"), (5, item.replace("then it", "then very it"))]
    got = {r.doc_id: r.reparameterised for r in dec.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(9, item)], ITEMS)).collect()}
    assert {d for d, t in rows if plain_matches(t, item)} == set(got)
    assert got == {4: True} | ({3: True, 5: False} if len(item.split()) - 4 - 4 >= 0.8 * (len(item.split()) - 4) else {})


def test_many_names_at_sentence_starts(spark):
    item = "Alice. Bob. Carl ran home and then Alice met Bob and Carl there"
    other = item.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carl", "Fred")
    got = dec.contaminated(spark.createDataFrame([(1, other)], DOCS), spark.createDataFrame([(2, item)], ITEMS)).collect()
    assert plain_matches(other, item) == (len(got) == 1) and got
