"""Text operators against literal cases and independent Python models."""

import random
import re

from pyspark.sql import functions as F

from relmill.functions.text import approx_tokens, estimate_tokens, safe_filename
from relmill.operators import text as T


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def pieces(df, order, value):
    out = {}
    for r in df.orderBy("doc_id", order).collect():
        out.setdefault(r["doc_id"], []).append(r[value])
    return out


def random_texts(seed, n, alphabet, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def tokens(text):
    cjk = sum("\u4e00" <= ch <= "\u9fff" for ch in text)
    words = len(re.findall(r"[A-Za-z0-9_+\-]+", text))
    punct = sum(ch in "，。！？；：,.!?;:（）()【】[]“”\"'、-" for ch in text)
    return cjk + words + max(1, punct // 4)


def test_image_markup(spark):
    marks = ["![map](maps/a.png)", "<IMG alt='x' src=b.gif>", "![see][fig]", "[fig]: figures/one.svg", "data:image/gif;base64,R0lGOD"]
    dirty = "".join(f"line {i}  ends\t\n\n{m}\n\n" for i, m in enumerate(marks))
    row = T.strip_image_markup(docs(spark, [dirty])).first()
    assert row["text"].split("\n\n") == [f"line {i} ends" for i in range(len(marks))]


def test_token_counts(spark):
    texts = random_texts(1, 300, "甲乙，。a b-1\"'、 \n", 40)
    rows = docs(spark, texts).select("text", approx_tokens(F.col("text")), estimate_tokens(F.col("text"))).collect()
    for text, approx, estimate in rows:
        assert approx == tokens(text), repr(text)
        assert estimate == ((len(text.strip()) + 1) // 2 if text.strip() else 0), repr(text)


def test_sentences_match_a_python_split(spark):
    texts = random_texts(2, 600, "甲乙。！?. \n\u3000a", 25)
    got = pieces(T.split_sentences(docs(spark, texts)), "sentence_ord", "sentence")
    for i, text in enumerate(texts):
        marked = ""
        for at, ch in enumerate(text):
            ends = ch in "。！？!?" or (ch == "." and text[at + 1 : at + 2].isspace())
            marked += ch + "\n" * ends
        want = [line.strip() for line in marked.split("\n") if line.strip()]
        assert got[i] == (want or [text]), repr(text)


def test_outline_starts(spark):
    text = "前言。一、总则。 1. 第一条；（二）第二条\n第3阶段 末。2.5 不是"
    got = pieces(T.split_outline(docs(spark, [text, "  "])), "piece_ord", "piece")
    assert got == {0: ["前言。", "一、总则。", "1. 第一条；", "（二）第二条", "第3阶段 末。2.5 不是"]}


def test_no_character_is_a_marker(spark):
    texts = ["a\uffffb one。\uffff 1. two \uffff", "\uffff"]
    got = pieces(T.split_outline(docs(spark, texts)), "piece_ord", "piece")
    assert got == {0: ["a\uffffb one。\uffff 1. two \uffff"], 1: ["\uffff"]}
    assert pieces(T.outline_units(docs(spark, ["x。 1. a\uffff b"]), 4), "unit_ord", "unit") == {0: ["x。", "1. a\uffff b"]}


def pack(sizes, budget):
    groups, total = [], None
    for i, n in enumerate(sizes):
        if total is None or total + n > budget:
            groups.append([i])
            total = n
        else:
            groups[-1].append(i)
            total += n
    return groups


def test_token_chunks(spark):
    texts = random_texts(3, 200, "甲乙丙。. a\n", 120)
    df = docs(spark, texts)
    units = pieces(T.outline_units(df, 8), "unit_ord", "unit")
    got = pieces(T.chunk_by_tokens(df, 8), "chunk_index", "chunk_text")
    for i in range(len(texts)):
        us = units.get(i, [])
        want = [" ".join(us[k] for k in g) for g in pack([tokens(u) for u in us], 8)]
        assert got.get(i, []) == want
        for chunk, group in zip(want, pack([tokens(u) for u in us], 8)):
            assert len(group) == 1 or sum(tokens(us[k]) for k in group) <= 8


def paragraphs(text):
    return [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]


def test_long_text(spark):
    limit = 9
    texts = [t for t in random_texts(4, 400, "ab c\n\n\n甲", 80) if t.strip()]
    got = pieces(T.split_long_text(docs(spark, texts), limit), "piece_ord", "piece")
    for i, text in enumerate(texts):
        assert all(p == p.strip() != "" and len(p) <= limit for p in got[i]), repr(text)
        assert re.sub(r"\s", "", "".join(got[i])) == re.sub(r"\s", "", text)
        parts = paragraphs(text)
        if max(map(len, parts)) <= limit:
            # a separator of two characters belongs to every paragraph, and one to spare in the limit
            groups = pack([len(p) + 2 for p in parts], limit + 2)
            assert got[i] == ["\n\n".join(parts[k] for k in g) for g in groups], repr(text)


def test_page_chunks(spark):
    limit = 30
    texts = [t for t in random_texts(4, 300, "ab c\n\n\n甲", 80) if t.strip()]
    cut = pieces(T.split_long_text(docs(spark, texts), limit), "piece_ord", "piece")
    rng = random.Random(5)
    books = [[(p + 1, rng.randrange(len(texts))) for p in range(rng.randint(0, 7))] for _ in range(120)]
    df = spark.createDataFrame(
        [(i, [(p, texts[t]) for p, t in book]) for i, book in enumerate(books)], "doc_id long, pages array<struct<page_index:int,text:string>>"
    )
    chunks = {}
    for r in T.chunk_by_chars(df, limit).orderBy("doc_id", F.length("chunk_id"), "chunk_id").collect():
        chunks.setdefault(r["doc_id"], []).append((r["text"], r["page_start"], r["page_end"]))
    for i, book in enumerate(books):
        want, run = [], []

        def close():
            for g in pack([len(t) + 2 for _, t in run], limit + 2):
                want.append(("\n\n".join(run[k][1] for k in g), run[g[0]][0], run[g[-1]][0]))
            run.clear()

        for page, t in book:
            if len(texts[t].strip()) <= limit:
                run.append((page, texts[t].strip()))
            else:
                close()
                want += [(p, page, page) for p in cut[t]]
        close()
        assert chunks.get(i, []) == want


def test_hard_split(spark):
    texts = random_texts(6, 400, "ab。；， \n甲", 90)
    got = pieces(T.hard_split(docs(spark, texts), 5), "piece_ord", "piece")
    for i, text in enumerate(texts):
        rest, want = text.strip(), []
        while len(rest) > 10:
            window = rest[:10]
            ends = [window.rfind(s) + len(s) for s in ("\n\n", "\n", "。", "；", "，", " ") if window.rfind(s) >= 5]
            cut = ends[0] if ends else 10
            want.append(rest[:cut].strip())
            rest = rest[cut:].strip()
        assert got.get(i, []) == want + ([rest] if rest else []), repr(text)


def test_profile(spark):
    row = T.corpus_profile(docs(spark, ["a b c. d e f. g h"]), 3, 4).first()
    assert (row["doc_token_count"], row["used_chunking"], row["chunk_count"]) == (9, True, 3)


def test_file_names(spark):
    names = {"plan.txt": "plan.txt", "up/../down/map.png": "map.png", "D:\\x\\y.doc": "y.doc", "c:d\x02e.md": "c_d_e.md", "tab\there": "tab_here", "...": "upload", "  ": "upload"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", safe_filename(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == names


def test_tokens_are_counted_in_few_passes(spark):
    """The count is taken of every text several times, so it may not walk it more often than it must."""
    rows = [("a b", 3), ("a-b +c_ 1", 4), ("\uffff x\uffff", 2), ("中文 ab", 4), ("é", 1), ("", 1), ("a, b. c; d: e!", 6)]
    df = spark.createDataFrame(rows, "t string, n int")
    count = approx_tokens(F.col("t"))
    got = df.select("n", count.alias("m"))
    assert [r["m"] for r in got.collect()] == [n for _, n in rows]
    plan = got._jdf.queryExecution().analyzed().toString()
    # CJK runs, punctuation, and one pass for the words
    assert plan.count("regexp_replace(") + plan.count("translate(") == 3


def test_token_count_takes_words_as_wholes(spark):
    """Against a plain count; latin words are matched whole, without a look back at every character."""
    texts = ["", "x", "xx x-x", "--a-b, c-d.", "中文，abc中文-ab。", "éa-bé+c_9", "''\"\"[]【】()（）;:!?？！-", "😀 -x😀-", "a￿b x中"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = rows.select("t", approx_tokens(F.col("t")).alias("n"))
    assert {r.t: r.n for r in counted.collect()} == {t: tokens(t) for t in texts}
    assert "(?<!" not in counted._jdf.queryExecution().optimizedPlan().toString()
