"""The run from layout results to document results, in turns with recorded replies."""

import os

import pytest
from pyspark.sql import functions as F

from relmill.config import RunConfig, SplitConfig
from relmill.operators import layout as O
from relmill.operators.skills import Skill
from relmill.operators.responses import RELATION_LIST
from relmill.operators.rollups import COUNTS
from relmill.plans import product, store
from relmill.streaming.tasks import STAGES

LAYOUT = f"doc_id long, pages array<{O.PAGE_TYPE}>, restructured struct<markdownText:string,markdown:string,text:string," \
    "layoutParsingResults:array<struct<prunedResult:string,markdown:struct<markdownText:string,text:string,content:string," \
    "images:map<string,string>>,markdownText:string,text:string>>>"


def skill(name, *words):
    return Skill(
        name=name, keywords=words, description=name, focus="f", head_prior="h", tail_prior="t", relation_style="s",
        negative_scope="n", fewshot=(), extraction_rules=(),
    )


SKILLS = [skill("staff", "joined", "manages"), skill("birds", "heron", "perch")]
CLEAR = "Alice joined ACME. Bob joined ACME. Carol joined ACME.\n\nShe manages Project Atlas, and Alice manages Project Atlas."


def item(head, relation, tail, evidence, skill="staff"):
    return f'{{"head":"{head}","relation":"{relation}","tail":"{tail}","evidence":"{evidence}","skill":"{skill}"}}'


def listed(*items):
    return '{"relation_list":[' + ",".join(items) + "]}"


def layout(spark, *texts):
    rows = [(i + 1, [(j + 1, "{}", t) for j, t in enumerate(pages)], None) for i, pages in enumerate(texts)]
    return spark.createDataFrame(rows, LAYOUT)


def test_one_batch_to_its_result(spark):
    taken = product.intake(layout(spark, [CLEAR], []))
    split = SplitConfig()
    first = product.advance(taken, SKILLS, RunConfig(fast_mode=True))
    asked = first.prompts.collect()
    assert [(p["kind"], p["unit_id"]) for p in asked] == [("extraction", "1/0")] and first.batches.count() == 0
    reply = listed(
        item("Alice", "works_for", "ACME", "Alice joined ACME."),
        item("Alice", "manages", "Project Atlas", "Alice manages Project Atlas."),
        item("Alice", "manages", "Project Atlas", "Alice manages Project Atlas."),
    )
    ledger = spark.createDataFrame([(p["prompt_id"], p["kind"], reply) for p in asked], product.LEDGER)
    turn = product.advance(taken, SKILLS, RunConfig(fast_mode=True), ledger)
    assert turn.prompts.count() == 0
    rows = {r["task_id"]: r for r in product.document_results(taken, turn.batches, split).collect()}
    done, failed = rows["1"], rows["2"]
    assert done["stage"] == "completed" and done["document_text"].startswith("Alice joined ACME")
    assert done["ocr_summary"]["ocr_restructure_fallback"] is True
    assert (done["ocr_summary"]["relation_batch_count"], done["ocr_summary"]["relation_count"]) == (1, 2)
    assert done["relation_split_config"]["split_mode"] == "small_section"
    assert [b["section_ids"] for b in done["relation_batches"]] == [["section-001"]]
    relations = done["final_relation_list"]
    assert [(r["head"], r["tail"]) for r in relations] == [("Alice", "ACME"), ("Alice", "Project Atlas")]
    assert relations[0].__fields__[:5] == ["head", "relation", "tail", "evidence", "skill"]
    assert relations[0]["source_sections"] == ["section-001"] and len(relations[0]["source_paragraphs"]) == 2
    assert done["proofreading"].asDict() == {
        "input_relation_count": 2, "high_confidence_count": 2, "low_confidence_count": 0, "output_relation_count": 2
    }
    assert done["routing"]["selected_skills"] == ["staff"] and not done["routing"]["cache_hit"]
    assert (failed["stage"], failed["error"]) == ("failed", "no pages recognised") and failed["final_relation_list"] == []
    assert {done["stage"], failed["stage"]} <= set(STAGES)


# both skills score the same, so the router is asked
LONG = " ".join(["The heron sat on a rock near Bob who joined ACME."] * 12)


@pytest.fixture(scope="module")
def run(spark):
    """The answers come turn by turn; those of targeted reviews are there before they are asked."""
    taken = product.intake(layout(spark, [LONG], [CLEAR], [LONG]))
    config = RunConfig(chunk_trigger=60, chunk_budget=40)
    answers = {
        "router": '{"primary_skill":"birds","aux_skills":["staff"],"reason":"both"}',
        "coref": '{"Grey Heron":["The heron"]}',
        "extraction": listed(
            item("Grey Heron", "sat on", "rock", "Grey Heron sat on a rock", "birds"), item("Bob", "joined", "ACME", "")
        ),
        "summarize": listed(item("Grey Heron", "sat on", "rock", "", "birds"), item("x", "涉及", "y", "nowhere")),
        "targeted": "no idea",
        "proofread": listed(item("Bob", "joined", "ACME", "Bob who joined ACME")),
    }
    rows, log, turn = [(f"targeted/{n}/0", "targeted", answers["targeted"]) for n in (1, 2, 3)], [], None
    for _ in range(5):
        ledger = spark.createDataFrame(rows, product.LEDGER)
        turn = product.advance(taken, SKILLS, config, ledger)
        asked = turn.prompts.collect()
        log.append([(p["kind"], p["unit_id"], p["prompt_id"], p["prompt"], p["max_tokens"]) for p in asked])
        if not asked:
            break
        rows += [(p["prompt_id"], p["kind"], answers[p["kind"]]) for p in asked]
    return taken, turn, log


def test_no_prompt_is_asked_twice(run):
    _, _, log = run
    ids = [p[2] for asked in log for p in asked]
    assert len(ids) == len(set(ids)) and log[-1] == []


def test_kinds_come_in_order(run):
    _, _, log = run
    kinds = [{p[0] for p in asked if not p[1].startswith("2/")} for asked in log]
    assert kinds[0] == {"router", "coref"} and kinds[1] == {"extraction"} and kinds[2] == {"summarize"}
    assert kinds[3] == {"proofread"} and "targeted" not in set().union(*kinds)
    # equal texts share a router prompt, nothing else
    assert sum(p[0] == "router" for p in log[0]) == 1 and sum(p[0] == "coref" for p in log[0]) == 2
    # a batch waits for its own prompts only
    assert ("extraction", "2/0") in {p[:2] for p in log[0]}
    assert {p[4] for asked in log for p in asked if p[0] == "proofread"} == {700}
    assert {p[4] for asked in log for p in asked if p[0] != "proofread"} == {900}
    assert all("Grey Heron sat" in p[3] for p in log[1] if p[0] == "extraction" and not p[1].startswith("2/"))


def test_long_batches_end_with_review_and_routes(run):
    taken, turn, _ = run
    rows = {r["task_id"]: r for r in product.document_results(taken, turn.batches).collect()}
    assert {r["stage"] for r in rows.values()} == {"completed"}
    assert [r["head"] for r in rows["1"]["final_relation_list"]] == [r["head"] for r in rows["3"]["final_relation_list"]]
    assert {"Grey Heron", "Bob"} <= {r["head"] for r in rows["1"]["final_relation_list"]}
    assert "x" not in {r["head"] for r in rows["1"]["final_relation_list"]}
    assert rows["1"]["routing"]["document_selected_skills"] == ["birds", "staff"]
    chunked = {r["unit_id"]: r for r in turn.batches.collect()}
    assert len(chunked["1/0"]["chunk_routes"]) == chunked["1/0"]["chunk_count"] > 1 and chunked["2/0"]["chunk_routes"] == []
    assert len(chunked["1/0"]["chunk_predictions"]) == chunked["1/0"]["chunk_count"]
    assert turn.routes.count() == 2


def test_waiting_documents_and_cached_routes(spark):
    taken = product.intake(layout(spark, [LONG]))
    config = RunConfig(chunk_trigger=10_000, fast_mode=True)
    first = product.advance(taken, SKILLS, config)
    assert [p["kind"] for p in first.prompts.collect()] == ["router"]
    waiting = product.document_results(taken, first.batches).first()
    assert waiting["stage"] == "relation_extraction" and waiting["final_relation_list"] == []
    # a model that gave up leaves the rules; the route is then known to the next run
    gone = spark.createDataFrame([(p["prompt_id"], "router", None) for p in first.prompts.collect()], product.LEDGER)
    second = product.advance(taken, SKILLS, config, gone)
    assert [p["kind"] for p in second.prompts.collect()] == ["extraction"]
    cached = product.advance(taken, SKILLS, config, None, second.routes)
    assert [p["kind"] for p in cached.prompts.collect()] == ["extraction"]


def test_results_move_sizes_not_texts(spark):
    taken = product.intake(layout(spark), SplitConfig())
    state = (
        "selected_skills array<string>, document_selected_skills array<string>, scores array<string>, cache_hit boolean, "
        f"chunk_routes array<string>, chunk_predictions array<string>, relations {RELATION_LIST}, {' long, '.join(COUNTS)} long"
    )
    batches = taken.batches.join(spark.range(1).select(F.from_json(F.col("id").cast("string"), state).alias("s")).select("s.*"))
    out = product.document_results(taken, batches).select("ocr_summary.document_text_length", "ocr_summary.relation_batch_count")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("char_length(document_text") > plan.index("Join")


def test_stored_tables_are_packed_tightly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "work_dir", lambda spark: f"{tmp_path}/t")
    assert store.stored(spark.range(3)).count() == 3
    assert [f for f in os.listdir(tmp_path / "t") if f.endswith(".zstd.parquet")]
