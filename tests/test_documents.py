"""Layout, sources, registry, roll-ups, streaming, whole run."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import document_queries
from relmill.config import RunConfig
from relmill.operators import layout as O
from relmill.operators import prompts as PR
from relmill.operators import provenance as V
from relmill.operators import routing as G
from relmill.operators import skills as R
from relmill.operators.coref import apply_aliases
from relmill.plans import corpus
from relmill.sources import scans as S
from relmill.sources import sinks as K
from relmill.streaming import tasks as W

BLOCKS = f"doc_id long, {O.BLOCKS_SCHEMA}"


def block(label, content, block_id, gid, group, page=None):
    return (label, content, [0.0, 0.0, 1.0, 1.0], block_id, gid, group, None, page)


def test_two_pages_of_blocks(spark):
    blocks = [
        block("text", "River report", 0, 0, 0), block("text", "The gauge reads low.", 1, 1, 1), block("number", "17", 2, 2, 2),
        block("text", "Rain is due.", 0, 3, 0), block("footer", "page end", 1, 4, 1), block("text", "Boats stay in.", 2, 5, 2),
    ]
    df = spark.createDataFrame([(8, 2, blocks)], BLOCKS)
    pages = {r["page_index"]: r["markdown_text"].split("\n\n") for r in O.pages_from_blocks(df).collect()}
    assert pages == {1: ["River report", "The gauge reads low."], 2: ["Rain is due.", "Boats stay in."]}
    assert [r["page"] for r in O.paragraphs_from_blocks(df).orderBy("paragraph_ord").collect()] == [1, 1, 2, 2]


def test_page_numbers_follow_a_step_by_step_walk(spark):
    rng = random.Random(1)
    lists = [
        [
            block(rng.choice(("text", "seal")), "x", i, rng.choice((i, None, max(i - 1, 0))), rng.choice((0, 0, 1, 2, None)),
                  rng.choice((None, None, None, 7)))
            for i in range(rng.randint(0, 9))
        ]
        for _ in range(400)
    ]
    df = spark.createDataFrame([(i, None, b) for i, b in enumerate(lists)], BLOCKS)
    got = {(r["doc_id"], r["block_key"]): r["page"] for r in O.infer_block_pages(df).collect()}
    want = {}
    for d, blocks in enumerate(lists):
        page, previous = 0, -1
        for label, _, _, own, gid, group, _, explicit in blocks:
            key = (d, own if gid is None else gid)
            if explicit is not None:
                want[key] = explicit
            elif label == "seal":
                want[key] = max(page, 1)
            else:
                group = group or 0
                page = max(page + (group == 0 and previous >= 0), 1)
                want[key], previous = page, group
    assert got == want


def test_page_text_variants(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"layoutParsingResults":[{"markdown":{"markdownText":"A"}},{"markdown":{"text":" B "}},'
        '{"markdown":{"content":"C"}},{"markdownText":"D"},{}]}'
    )
    rows = S.scan_layout_results(spark, str(tmp_path)).orderBy("page_index").collect()
    assert [(r["doc_id"], r["markdown_text"]) for r in rows] == [("a", t) for t in ("A", "B", "C", "D", "")]


def test_failed_restructuring_falls_back_to_pages(spark):
    pages = [(1, "{}", "A ![x](y)"), (2, "{}", "B")]
    df = spark.createDataFrame(
        [(1, pages, None), (2, [], None)],
        f"doc_id long, pages array<{O.PAGE_TYPE}>, restructured {O.RESTRUCTURED_TYPE}",
    )
    good, bad = O.assemble_document(df).orderBy("doc_id").collect()
    assert (good["document_text"], good["ocr_restructure_fallback"], good["page_count"]) == ("A\n\nB", True, 2)
    assert bad["error"] and bad["document_text"] is None


def test_file_kinds(spark):
    rows = [("scan", b"%PDF-1.4 and more"), ("photo.PNG", b"whatever"), ("frame", b"RIFF\0\0\0\0WEBPVP8 "), ("note.txt", b"plain words"), ("", b"")]
    known, unknown = S.classify_files(spark.createDataFrame(rows, "filename string, content binary"))
    kinds = {r["filename"]: (r["stored_filename"], r["file_type"]) for r in known.collect()}
    assert kinds == {"scan": ("scan.pdf", 0), "photo.PNG": ("photo.PNG", 1), "frame": ("frame.webp", 1)}
    assert {r["filename"] for r in unknown.collect()} == {"note.txt", ""}


def test_samples_keep_their_line_numbers(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"sample_id":"a","output":"x"}\n{"sample_id":"b"}\n{"sample_id":"c","output":"y"}\n')
    rows = S.scan_samples(spark, str(tmp_path)).orderBy("sample_index").collect()
    assert [(r["sample_index"], r["sample_id"], r["doc_text"]) for r in rows] == [(0, "a", "x"), (1, "b", ""), (2, "c", "y")]
    kept = S.scan_samples(spark, str(tmp_path), 2, skip_empty=True).collect()
    assert [r["sample_index"] for r in kept] == [0, 2]


def test_broken_sample_lines(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text('{"sample_id":"a","output":"x"}\n' * (k + 1) + '{"sample_id": broken\n[1]\n{"sample_id":"z","output":"y"}\n')
    rows = S.scan_samples(spark, str(tmp_path)).collect()
    bad = S.bad_samples(spark, str(tmp_path)).collect()
    assert sorted(r["sample_index"] for r in rows) == [0, 3, 4, 5, 8, 9, 10, 11, 14]
    assert {r["sample_index"]: r["line"] for r in bad if "broken" in r["line"]} == {i: '{"sample_id": broken' for i in (1, 6, 12)}


def skill_row(name, keywords=("tide",), json='{"relation_list":[{"head":"moon"}]}'):
    return (name, "about", "focus", "heads", "tails", "style", "limits", ["look twice"], list(keywords), [("the moon pulls", json, None)])


def test_registry_create_rename_reject(spark):
    registry = spark.createDataFrame([skill_row("sea"), skill_row("sky")], R.SKILL_SCHEMA)
    rows = [
        (*skill_row("ocean", ("tide", "wave", "salt")), "update", "sea"),
        (*skill_row("sky"), "create", None),
        (*skill_row("fog"), "update", "mist"),
        (*skill_row("land"), "create", None),
    ]
    changes = spark.createDataFrame(rows, R.SKILL_SCHEMA + ", action string, target string")
    new, rejected = R.upsert_skills(registry, changes)
    assert {r["name"]: len(r["keywords"]) for r in new.collect()} == {"ocean": 3, "sky": 1, "land": 1}
    assert {r["name"]: r["reason"] for r in rejected.collect()} == {"sky": "conflict", "fog": "not found"}


def test_registry_validation(spark):
    rows = [skill_row("ok"), skill_row("b d"), skill_row("x", json='{"not_relation_list":[]}'), skill_row("y", (" ",))]
    got = R.validate_skills(spark.createDataFrame(rows, R.SKILL_SCHEMA)).collect()
    assert [r["error"] for r in got] == [
        None, "bad name", "fewshot[1].json must contain relation_list", "field must not be empty: keywords",
    ]


def test_skill_folder_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(
            f'{{"name":"{name}","keywords":["k{name}"],"extraction_rules":[],'
            '"fewshot":[{"text":"t","json":{"relation_list":[{"head":"x"},{"head":"y"}]}}]}'
        )
    skills = R.registry_of(S.scan_skills(spark, str(tmp_path)))
    assert [(s.name, s.keywords, s.fewshot[0].is_document_level) for s in skills] == [("a", ("ka",), True), ("b", ("kb",), True)]


SKILLS = [R.Skill("a", ("alpha", "x")), R.Skill("b", ("beta", "x")), R.Skill("c", ("gamma",)), R.Skill("d", ())]


def test_routing_rules(spark):
    df = spark.createDataFrame([(1, "alpha alpha beta"), (2, "nothing"), (3, "x")], "doc_id long, text string")
    scored = G.needs_model_route(G.select_skills(G.keyword_scores(df, SKILLS)))
    got = {r["doc_id"]: (r["selected_skills"], r["needs_model"]) for r in scored.collect()}
    assert got == {1: (["a", "b"], False), 2: (["a", "b", "c"], True), 3: (["a", "b"], True)}


def test_general_numbers(spark):
    values = [0.0, 1.0, 12.5, 123.45, 99999.99, 12345.67, 123456.78, 1234567.89]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(G.general_number(F.col("v")).alias("s"))
    assert [r["s"] for r in df.collect()] == [f"{v:g}" for v in values]


def test_big_lexicon_scores_like_a_small_one(spark):
    words = [f"w{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(1, "w001 w001 w150 w199")], "doc_id long, text string")
    row = G.keyword_scores(df, [R.Skill("a", tuple(words)), R.Skill("b", ("z",))]).first()
    assert row["scores"][0]["score"] == pytest.approx(round(4 * 1.5 * (1 + 0.6931471805599453), 2))


def test_missing_route_cache_is_empty(spark, tmp_path):
    assert S.read_route_cache(spark, str(tmp_path / "none")).count() == 0


def test_provenance_values(spark):
    paragraph = "struct<page:int,label:string,content:string,bbox:array<double>,global_block_id:int>"
    section = (
        "struct<section_id:string,title:string,parent_title:string,page_start:int,page_end:int,"
        f"block_ids:array<int>,text:string,paragraphs:array<{paragraph}>>"
    )
    p = lambda c: (None, "markdown", c, None, None)
    lines = ["The heron eats fish.", "Reeds grow tall."]
    sections = [("4.2", "birds", "", 1, 1, [], "\n\n".join(lines), [p(x) for x in lines])]
    relations = [("heron", "eats", "fish", "heron eats fish", "s"), ("owl", "hunts", "mice", "", "s"), (None, "grow", "tall", "Reeds grow", "s")]
    df = spark.createDataFrame(
        [(1, 0, ["4.2"], [], sections, relations)],
        f"doc_id long, batch_index int, section_ids array<string>, block_ids array<int>, sections array<{section}>, "
        "relations array<struct<head:string,relation:string,tail:string,evidence:string,skill:string>>",
    )
    hit, miss, headless = V.attach_sources(df).orderBy("relation_ord").collect()
    found = [[m["content"] for m in r["source_paragraphs"]] for r in (hit, miss, headless)]
    assert found == [lines[:1], [], lines]  # an empty head is in every paragraph
    assert {tuple(r["source_sections"]) for r in (hit, miss, headless)} == {("4.2",)}
    assert (hit["source_pages"], miss["source_pages"]) == ([], [1])
    twice = V.attach_sources(df.union(df.withColumn("batch_index", F.lit(1))))
    assert V.dedup_document(twice.drop("batch_index")).count() == 3
    # the same under the other names, and where both are there an empty head gives way to the subject
    other = df.withColumn("relations", F.transform("relations", lambda r: F.struct(
        r["head"].alias("subject"), r["relation"].alias("relation"), r["tail"].alias("object"), r["evidence"].alias("evidence"))))
    named = V.attach_sources(other).orderBy("relation_ord")
    assert [[m["content"] for m in r["source_paragraphs"]] for r in named.collect()] == found and "subject" in named.columns
    both = df.withColumn("relations", F.transform("relations", lambda r: r.withField("subject", r["head"]).withField("head", F.lit(""))))
    assert [[m["content"] for m in r["source_paragraphs"]] for r in V.attach_sources(both).orderBy("relation_ord").collect()] == found
    mixed = V.attach_sources(other.union(other.withColumn("batch_index", F.lit(1))))
    assert V.dedup_document(mixed.drop("batch_index")).count() == 3
    plan = V.attach_sources(df)._jdf.queryExecution().optimizedPlan().toString()
    generator = next(line for line in plan.splitlines() if "Generate" in line)
    assert "sections#" not in generator


def test_aliases_longest_first(spark):
    reply = 'Names: {"Grey Heron Ltd": ["heron", "the heron", "h"], "Lake": "water", "P": ["pp"]} and no more'
    df = spark.createDataFrame([(1, "the heron sells. heron buys. " * 3, reply)], "doc_id long, text string, reply string")
    row = apply_aliases(df, 5).first()
    assert (row["text"], row["coref_groups"]) == ("Grey Heron Ltd sells. Grey Heron Ltd buys. " * 3, 1)


def test_prompts_hold_their_parts(spark):
    skills = [R.Skill("a", ("alpha",), focus="F", fewshot=(R.Example("alpha t", "{}", False),), extraction_rules=("own",))]
    df = spark.createDataFrame([(1, "alpha text", ["a"])], "doc_id long, chunk_text string, selected_skills array<string>")
    prompt = PR.extraction_prompts(df, skills).first()["prompt"]
    for part in ("* a | 关心 F |", "a 片段样例 | alpha t\n应答 | {}", ". own\n", "【待处理文本】\nalpha text\n"):
        assert part in prompt


def test_artefacts_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("t1", " text \n", None, "secret")], "task_id string, document_text string, paragraphs array<string>, _pages_res string")
    paths = K.write_results(df, str(tmp_path))
    folder = tmp_path / "document_text_md" / "task_id=t1"
    assert [f.read_text() for f in folder.glob("part-*")] == ["text\n"]
    assert "secret" not in spark.read.text(paths["result_json"]).first()["value"]
    assert spark.read.text(paths["ocr_paragraphs_json"]).first()["value"] == "[]"


def test_stream_survives_empty_documents(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "one. two"), (2, "  ")], "doc_id long, text string").write.parquet(source)
    query = W.stream_documents(
        spark, source, "doc_id long, text string", lambda d: d.select("doc_id"), out, str(tmp_path / "cp"), max_files=1
    )
    query.awaitTermination()
    assert [r["doc_id"] for r in spark.read.parquet(f"{out}/results").collect()] == [1]
    assert [r["doc_id"] for r in spark.read.parquet(f"{out}/errors").collect()] == [2]
    status = {r["task_id"]: r["status"] for r in spark.read.parquet(f"{out}/status").collect()}
    assert status == {"1": "succeeded", "2": "failed"}


def test_stream_survives_failing_documents(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"text {i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(source)

    def transform(docs):
        broken = F.raise_error(F.concat(F.lit("no way with "), F.col("text"))).cast("string")
        return docs.select("doc_id", F.when(F.col("doc_id").isin(7, 31), broken).otherwise(F.col("text")).alias("t"))

    for run in range(2):
        # the second run replays the same micro-batch
        query = W.stream_documents(spark, source, "doc_id long, text string", transform, out, str(tmp_path / f"cp{run}"))
        query.awaitTermination()
        errors = {r["doc_id"]: r["error"] for r in spark.read.parquet(f"{out}/errors").collect()}
        assert set(errors) == {7, 31} and all(errors.values())
        done = sorted(r["doc_id"] for r in spark.read.parquet(f"{out}/results").collect())
        assert done == [i for i in range(40) if i not in (7, 31)]
        status = [r["status"] for r in spark.read.parquet(f"{out}/status").collect()]
        assert sorted(status) == ["failed"] * 2 + ["succeeded"] * 38
    with pytest.raises(Exception):
        W.stream_documents(
            spark, source, "doc_id long, text string", transform, out, str(tmp_path / "cp2"), max_failures=1
        ).awaitTermination()


def test_latest_status_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a", "queued", 1), ("a", "document_merge", 3), ("b", "failed", 2), ("a", "layout_parsing", 2)]
    log = spark.createDataFrame(rows, "task_id string, stage string, t int").select(
        "task_id", "stage", F.timestamp_seconds("t").alias("updated_at"), F.lit("e").alias("error")
    )
    log.write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    query = (
        W.latest_status(W.status_log(stream)).writeStream.outputMode("update").format("memory").queryName("latest_states").start()
    )
    query.processAllAvailable()
    query.stop()
    got = {r["task_id"]: (r["status"], r["progress"]) for r in spark.table("latest_states").collect()}
    assert got == {"a": ("merging", 85), "b": ("failed", 100)}


def test_whole_run(spark):
    text = "alpha meets beta. gamma meets delta. " * 3
    docs = spark.createDataFrame([(1, text), (2, "alpha meets beta."), (3, " ")], "doc_id long, text string")
    config = RunConfig(chunk_trigger=12, chunk_budget=8)
    prepared = corpus.prepare(docs, SKILLS, config)
    chunks = prepared.chunks.collect()
    assert {c["doc_id"] for c in chunks} == {1, 2} and sum(c["doc_id"] == 2 for c in chunks) == 1
    assert all(r["max_tokens"] == 900 for r in prepared.prompts.collect())
    reply = '{"relation_list":[{"head":"alpha","relation":"meets","tail":"beta","evidence":"alpha meets beta","skill":"a"},' \
            '{"head":"made","relation":"up","tail":"fact","evidence":"none","skill":"a"}]}'
    replies = prepared.chunks.select("prompt_id", F.lit(reply).alias("reply"))
    got = corpus.extract_corpus(docs, replies, SKILLS, config).collect()
    assert sorted((r["doc_id"], r["head"], r["tail"]) for r in got) == [(1, "alpha", "beta"), (2, "alpha", "beta")]


def test_run_is_grounded_in_rewritten_text(spark):
    docs = spark.createDataFrame([(1, "the bird eats fish. the bird naps. " * 3)], "doc_id long, text string")
    coref = spark.createDataFrame([(1, '{"Grey Heron": ["the bird"]}')], "doc_id long, reply string")
    config = RunConfig(chunk_trigger=12, chunk_budget=8, fast_mode=True)
    prepared = corpus.prepare(docs, SKILLS, config, coref_replies=coref)
    reply = '{"relation_list":[{"head":"Grey Heron","relation":"eats","tail":"fish","evidence":"","skill":"a"}]}'
    replies = prepared.chunks.select("prompt_id", F.lit(reply).alias("reply"))
    got = corpus.extract_corpus(docs, replies, SKILLS, config, coref_replies=coref).collect()
    assert [r["head"] for r in got] == ["Grey Heron"] and got[0]["evidence"].startswith("Grey Heron")


def test_limit_counts_only_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGE_LINES", 4)
    lines = ['{"sample_id":"%d","output":"%s"}' % (i, "" if i % 3 else f"text {i}") for i in range(40)]
    for part in range(2):
        (tmp_path / f"part-{part}.txt").write_text("\n".join(lines[part * 20 : part * 20 + 20]) + "\n")
    every = [i for i in range(40) if i % 3 == 0]
    for limit in (-1, 0, 1, 3, 7, 14, 99):
        got = S.scan_samples(spark, str(tmp_path), limit, skip_empty=True).collect()
        assert sorted(r["sample_index"] for r in got) == every[: max(0, limit)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("")
    assert S.scan_samples(spark, str(tmp_path / "none"), 5, skip_empty=True).collect() == []


@pytest.mark.parametrize("as_folder", [False, True])
def test_streams_read_a_file_or_a_folder(spark, tmp_path, as_folder):
    import shutil

    from catalog import document_queries as Q

    docs = spark.createDataFrame(
        [(i, f"One two {i}. Three four.", "en", "s", 20) for i in range(6)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    path = tmp_path / "documents.parquet"
    docs.repartition(3).write.parquet(str(path if as_folder else tmp_path / "written"))
    if not as_folder:
        docs.coalesce(1).write.parquet(str(tmp_path / "single"))
        shutil.copy(next((tmp_path / "single").glob("part-*.parquet")), path)
    sentences = Q.stream_documents(spark, str(tmp_path))
    assert sentences.count() == 12 and sentences.select("doc_id").distinct().count() == 6
    states = {r["task_id"]: (r["status"], r["n"]) for r in Q.failing_document(spark, str(tmp_path)).collect()}
    assert states == {str(i): ("failed", 0) if i == 1 else ("succeeded", 22) for i in range(6)}


def test_document_dedup_moves_each_text_once(spark, tmp_path):
    rows = [(i, "A b c.\n" * (i + 1), "en", "s", 7) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = document_queries.dedup_document(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert df.select("doc_id").distinct().count() == 5
