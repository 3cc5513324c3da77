"""From layout results to document results, in turns with the external model.

:func:`intake` assembles documents and cuts them into relation batches. :func:`advance`
carries every batch as far as the replies allow: routes, rewritten text, chunks, merge,
review. What it still has to ask comes back as prompts; their replies go into a ledger
``(prompt_id, kind, reply)``, and the next turn finds them there by an anti-join. A batch
waits only for its own prompts. :func:`document_results` puts finished batches together.

A reply that is null stands for a model that gave up: the batch goes on without it, by
rules where there are any. Of several replies to one prompt the greatest counts. A turn
starts from the batches again and depends on nothing but its inputs, so a lost run is
simply repeated; only the prompts cost, and answered ones are not asked twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.config import RunConfig, SplitConfig
from relmill.functions.text import approx_tokens, doc_hash
from relmill.operators.batches import PUBLIC_COLUMNS, build_batches
from relmill.operators.layout import assemble_document
from relmill.operators.prompts import prompt_budget, review_prompts, router_prompts
from relmill.operators.provenance import attach_sources, dedup_document
from relmill.operators.relations import FIELDS, score_confidence, with_witness
from relmill.operators.responses import RELATION_LIST, parse_responses, split_parsed
from relmill.operators.review import apply_review, merge_chunks
from relmill.operators.rollups import COUNTS, order_fields, rollup_batches
from relmill.operators.routing import (
    document_skill_total,
    fresh_routes,
    keyword_scores,
    known_names,
    needs_chunk_reroute,
)
from relmill.operators.sections import sections_of_paragraphs
from relmill.operators.skills import Skill
from relmill.operators.text import clean_images, page_chunk_array, paragraph_array
from relmill.plans.corpus import chunk_prompts, chunk_relations, prepare
from relmill.plans.store import stored

LEDGER = "prompt_id string, kind string, reply string"
# ---- fixed values -------------------------------------------------------------------------
MAX_CHUNK_CHARS = 2400
#: kind of prompt → name of its token limit
TASKS = {"summarize": "summarize", "targeted": "targeted_proofread", "proofread": "proofreading"}
# -------------------------------------------------------------------------------------------
ORDER = ("chunk_index", "relation_ord", "part_ord")
ASKED = ("prompt_id", "kind", "unit_id", "prompt")


@dataclass(frozen=True)
class Intake:
    """``documents`` with their outcome so far, ``batches`` with one row per unit of extraction."""

    documents: DataFrame
    batches: DataFrame


@dataclass(frozen=True)
class Turn:
    """Open ``prompts``, finished ``batches``, and ``routes`` for the route cache."""

    prompts: DataFrame
    batches: DataFrame
    routes: DataFrame


def intake(
    layout: DataFrame,
    split: SplitConfig = SplitConfig(),
    max_chunk_chars: int = MAX_CHUNK_CHARS,
    result: str = "restructured",
    pages: str = "pages",
) -> Intake:
    """Layout rows ``(doc_id, pages, restructured)`` → documents and their batches.

    A document without pages has an ``error`` and no batches. Everything happens inside the
    document row. Sections are read off the stored text wherever they are needed: with their
    paragraphs they would take twice its room again.
    """
    shown = F.transform(
        pages, lambda p: F.struct(p["page_index"].alias("page_index"), clean_images(p["markdown_text"]).alias("text"))
    )
    text = F.coalesce("document_text", F.lit(""))
    documents = stored(
        assemble_document(layout, result, pages, keep=("doc_id", pages)).select(
            "doc_id",
            text.alias("document_text"),
            "ocr_restructure_fallback",
            "page_count",
            "error",
            page_chunk_array(shown, max_chunk_chars).alias("chunks"),
        )
    ).withColumn("sections", sections_of_paragraphs(paragraph_array(F.col("document_text")), split.include_parent_title))
    rows = build_batches(documents.filter("error IS NULL"), split, text="document_text")
    unit = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("batch_index").cast("string"))
    return Intake(documents, stored(rows.withColumn("unit_id", unit)))


def settled(ledger: DataFrame) -> DataFrame:
    """One reply per prompt."""
    return ledger.groupBy("prompt_id", "kind").agg(F.max("reply").alias("reply"))


def _named(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), key)


def _asked(rows: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """Rows with a prompt, as prompts of a kind; ``doc_id`` is the unit here."""
    return rows.select(
        _named(kind, F.col(key)).alias("prompt_id"), F.lit(kind).alias("kind"), F.col("doc_id").alias("unit_id"), "prompt"
    )


def _replies(ledger: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """Replies of a kind under the key that their prompts were named after."""
    return ledger.filter(F.col("kind") == kind).select(
        F.substr("prompt_id", F.lit(len(kind) + 2)).alias(key), "reply"
    )


def _open(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    return stored(asked.join(ledger.select("prompt_id"), "prompt_id", "left_anti").select(*ASKED))


def _of_kind(ledger: DataFrame, *kinds: str) -> DataFrame:
    return ledger.filter(F.col("kind").isin(*kinds))


def _without(rows: DataFrame, *open_prompts: DataFrame) -> DataFrame:
    """Rows of the units that wait for none of these prompts."""
    for prompts in open_prompts:
        rows = rows.join(prompts.select(F.col("unit_id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    return rows


def _router_asks(
    scored: DataFrame, skills: Sequence[Skill], text: str, cache: DataFrame | None
) -> DataFrame:
    """Router prompts of the texts that the cache has no usable route for, named by text hash."""
    if cache is not None:
        usable = cache.filter(F.size(known_names(F.col("route.selected_skills"), skills)) > 0)
        scored = scored.join(usable.select("doc_hash"), "doc_hash", "left_anti")
    return _asked(router_prompts(scored, skills, text), "router", "doc_hash")


def _relation_lists(rows: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str) -> DataFrame:
    """Relations of a key as an ordered array; a key is a batch or less, so it is bounded."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*FIELDS).alias("r"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["r"]).cast(RELATION_LIST).alias(alias))


def _summary_asks(
    chunks: DataFrame, per_chunk: DataFrame, texts: DataFrame, skills: Sequence[Skill]
) -> DataFrame:
    """Prompts that merge the results of batches with several chunks."""
    keys = ["doc_id", "chunk_index"]
    lists = _relation_lists(per_chunk, keys, ORDER[1:], "relation_list")
    rows = chunks.filter("used_chunking").select(*keys, "document_skills").join(lists, keys, "left")
    result = F.struct("chunk_index", F.coalesce("relation_list", F.array().cast(RELATION_LIST)).alias("relation_list"))
    units = rows.groupBy("doc_id").agg(
        F.any_value("document_skills").alias("selected_skills"),
        F.array_sort(F.collect_list(F.struct("chunk_index", result.alias("c")))).alias("_c"),
    )
    units = units.withColumn("chunk_results", F.transform("_c", lambda x: x["c"])).drop("_c")
    return _asked(review_prompts(units.join(texts, "doc_id"), "summarize", skills), "summarize")


def _review_asks(
    scored: DataFrame, kind: str, totals: DataFrame, texts: DataFrame, skills: Sequence[Skill]
) -> DataFrame:
    lists = _relation_lists(scored, ["doc_id"], ORDER, "relations")
    return _asked(review_prompts(lists.join(totals, "doc_id", "left").join(texts, "doc_id"), kind, skills), kind)


def advance(
    taken: Intake,
    skills: Sequence[Skill],
    config: RunConfig = RunConfig(),
    ledger: DataFrame | None = None,
    cache: DataFrame | None = None,
    default_rules: Mapping[str, Sequence[str]] | None = None,
) -> Turn:
    """One turn over all batches; see the module.

    ``ledger`` holds all replies so far, ``cache`` is a route cache as read back
    (``doc_hash, route``). Prompts: ``prompt_id, kind, unit_id, prompt`` with token limit and
    temperature; one per text for routers, one per chunk for extraction, else one per batch.
    """
    spark = taken.batches.sparkSession
    ledger = stored(settled(spark.createDataFrame([], LEDGER) if ledger is None else ledger))
    units = taken.batches.select(F.col("unit_id").alias("doc_id"), "text")

    # 1. routes of whole batches, aliases of long ones
    scored = keyword_scores(units, skills).withColumn("doc_hash", doc_hash(F.col("text")))
    first = _router_asks(scored, skills, "text", cache)
    if not config.skip_coref:
        long = units.filter(approx_tokens(F.col("text")) > config.chunk_trigger)
        first = first.unionByName(_asked(review_prompts(long, "coref"), "coref"))
    open_first = _open(first, _of_kind(ledger, "router", "coref"))

    # 2. chunks, and routes of those that drift
    prepared = prepare(
        _without(units, open_first),
        skills,
        config,
        cache,
        router_replies=_replies(ledger, "router", "doc_hash"),
        coref_replies=_replies(ledger, "coref"),
        default_rules=default_rules,
    )
    chunks, texts = prepared.chunks, prepared.documents
    routes = prepared.routes
    moved = keyword_scores(chunks.filter("used_chunking"), skills, "chunk_text").withColumn(
        "doc_hash", doc_hash(F.col("chunk_text"))
    )
    drifting = needs_chunk_reroute(moved, len(skills)).filter("reroute")
    open_chunks = _open(_router_asks(drifting, skills, "chunk_text", cache), _of_kind(ledger, "router"))

    # 3. extraction
    replies = _of_kind(ledger, "extraction")
    chunks = _without(chunks, open_chunks)
    unanswered = chunks.join(replies.select("prompt_id"), "prompt_id", "left_anti")
    open_extraction = stored(
        chunk_prompts(unanswered, skills, config, default_rules).select(
            "prompt_id", F.lit("extraction").alias("kind"), F.col("doc_id").alias("unit_id"), "prompt"
        )
    )
    chunks = _without(chunks, open_extraction)
    parsed = stored(parse_responses(replies.select("prompt_id", "reply")).select("prompt_id", "relations"))
    per_chunk = stored(chunk_relations(chunks, replies, skills, parsed))

    # 4. one list per batch
    long = per_chunk.filter("used_chunking").drop("used_chunking")
    summaries, open_summary = None, spark.createDataFrame([], ", ".join(f"{c} string" for c in ASKED))
    if not config.fast_mode:
        open_summary = _open(_summary_asks(chunks, long, texts, skills), _of_kind(ledger, "summarize"))
        summaries = parse_responses(_replies(ledger, "summarize")).select("doc_id", "relations")
    names = [s.name for s in skills]
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    merged = merge_chunks(
        _without(long, open_summary).drop("part_ord"), counts, summaries, texts, config.fast_mode, names
    )
    short = per_chunk.filter("not used_chunking").select(*merged.columns)
    relations = stored(merged.unionByName(short))

    # 5. review of doubtful relations
    done = _without(chunks, open_summary)
    totals = stored(document_skill_total(done))
    if config.fast_mode:
        lists = _relation_lists(relations, ["doc_id"], ORDER, "relations")
        n = F.size("relations").cast("long")
        finished = lists.select(
            "doc_id", "relations", *[(F.lit(0).cast("long") if "low" in c else n).alias(c) for c in COUNTS]
        )
        reviews = []
    else:
        witnessed = with_witness(texts).select("doc_id", "source_compact")
        judged = score_confidence(relations.join(witnessed, "doc_id")).select(
            "doc_id", *ORDER, *FIELDS, (F.col("confidence") < config.confidence_threshold).alias("low")
        )
        judged = stored(judged)
        doubtful = judged.filter("low")
        open_targeted = _open(_review_asks(doubtful, "targeted", totals, texts, skills), _of_kind(ledger, "targeted"))
        targeted, failed = split_parsed(parse_responses(_replies(ledger, "targeted")))
        # a targeted reply that can't be read is followed by a review of the whole list
        again = judged.join(doubtful.select("doc_id").distinct(), "doc_id", "left_semi").join(
            failed.select("doc_id"), "doc_id", "left_semi"
        )
        open_full = _open(_review_asks(again, "proofread", totals, texts, skills), _of_kind(ledger, "proofread"))
        proofread, _ = split_parsed(parse_responses(_replies(ledger, "proofread")))
        reviews = [open_targeted, open_full]
        revised, review_counts = apply_review(
            _without(relations, *reviews),
            texts,
            targeted.select("doc_id", "relations"),
            proofread.select("doc_id", "relations"),
            names,
            order=ORDER,
            threshold=config.confidence_threshold,
            position="at",
        )
        finished = review_counts.join(_relation_lists(revised, ["doc_id"], ["at"], "relations"), "doc_id", "left")

    # 6. finished batches with their routes
    pieces = F.struct("chunk_index", "selected_skills", "routing_mode")
    chunk_routes = done.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("used_chunking"), pieces))).alias("chunk_routes"),
        F.count("*").alias("chunk_count"),
        F.any_value("used_chunking").alias("used_chunking"),
    )
    predicted = (
        done.select("doc_id", "chunk_index", "prompt_id")
        .join(parsed, "prompt_id")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("relations").alias("relation_list")))).alias("chunk_predictions"))
    )
    own = routes.select(
        "doc_id", F.col("selected_skills").alias("document_selected_skills"), "scores", "router_reason", "router_mode", "cache_hit"
    )
    state = _without(own, *reviews)
    for table in (chunk_routes, predicted):
        state = state.join(table, "doc_id")
    for table in (totals, finished.select("doc_id", "relations", *COUNTS)):
        state = state.join(table, "doc_id", "left")
    state = state.withColumns(
        {
            "selected_skills": F.coalesce("selected_skills", "document_selected_skills"),
            "relations": F.coalesce("relations", F.array().cast(RELATION_LIST)),
            **{c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS},
        }
    )
    # written by itself: while few batches are finished, the others' texts stay where they are
    state = stored(state.withColumnRenamed("doc_id", "unit_id"))
    batches = stored(taken.batches.join(state, "unit_id"))

    waiting = open_first
    for more in (open_chunks, open_extraction, open_summary, *reviews):
        waiting = waiting.unionByName(more)
    # equal texts share their router prompt
    single = waiting.groupBy("prompt_id", "kind").agg(F.min("unit_id").alias("unit_id"), F.any_value("prompt").alias("prompt"))
    pairs = F.create_map(*[F.lit(x) for pair in TASKS.items() for x in pair])
    tasks = single.withColumns(
        {"task": F.coalesce(F.try_element_at(pairs, "kind"), F.lit("extraction")), "backend": F.lit(config.backend)}
    )
    return Turn(prompt_budget(tasks), batches, fresh_routes(routes))


def document_results(
    taken: Intake, batches: DataFrame, split: SplitConfig = SplitConfig(), config: RunConfig = RunConfig()
) -> DataFrame:
    """One result row per document: final relations with sources, routing, counts, stage.

    ``batches`` are the finished ones of a :class:`Turn`. ``stage`` is ``failed`` with its
    ``error``, ``completed``, or ``relation_extraction`` while batches wait; the columns of
    such a document hold what is known so far. Times are not measured: batches of many
    documents run in the same stages.
    """
    # batches are dealt out by document before they grow into relations with copies of their paragraphs
    dealt = batches.select("doc_id", "batch_index", "section_ids", "block_ids", "sections", "relations").repartition("doc_id")
    final = order_fields(dedup_document(attach_sources(dealt).drop("batch_index")), keep=("doc_id",))
    fields = [c for c in final.columns if c != "doc_id"]
    listed = F.array_sort(F.collect_list(F.struct("source_batch_index", "relation_ord", F.struct(*fields).alias("r"))))
    relations = final.groupBy("doc_id").agg(F.transform(listed, lambda x: x["r"]).alias("final_relation_list"))
    label = ("batch_index", "split_mode", "section_ids")
    n = F.size("relations").alias("relation_count")

    def per_batch(alias: str, *columns: str | Column) -> Column:
        """Ordered by their first field, the batch number."""
        return F.array_sort(F.collect_list(F.struct(*columns))).alias(alias)

    detail = batches.groupBy("doc_id").agg(
        per_batch("relation_batches", *PUBLIC_COLUMNS, n),
        per_batch("chunk_routes", *label, "chunk_routes"),
        per_batch("chunk_predictions", *label, "chunk_predictions"),
        per_batch("scores", "batch_index", "scores"),
        F.struct(*[F.sum(c).alias(c) for c in COUNTS]).alias("proofreading"),
    )
    planned = taken.batches.groupBy("doc_id").agg(F.count("*").alias("planned"))
    # sizes are taken before the joins, which move only columns that the caller reads
    rows = taken.documents.withColumns(
        {"_length": F.char_length("document_text"), "_chunks": F.size("chunks"), "_sections": F.size("sections")}
    )
    for table in (rollup_batches(batches), detail, relations, planned):
        rows = rows.join(table, "doc_id", "left")
    done, planned_count = F.coalesce("batch_count", F.lit(0)), F.coalesce("planned", F.lit(0))
    none = F.array().cast("array<string>")
    settings = F.struct(
        F.lit(split.split_mode).alias("split_mode"),
        F.lit(split.batch_size).alias("batch_size"),
        F.lit(split.max_batch_tokens).alias("max_batch_tokens"),
        F.lit(split.include_parent_title).alias("include_parent_title"),
    )
    found = F.coalesce("final_relation_list", F.array().cast(relations.schema["final_relation_list"].dataType))
    skills = F.coalesce("selected_skills", none)
    return rows.select(
        F.col("doc_id").cast("string").alias("task_id"),
        F.when(F.col("error").isNotNull(), "failed")
        .when(done < planned_count, "relation_extraction")
        .otherwise("completed")
        .alias("stage"),
        "error",
        F.struct(
            F.col("doc_id").cast("string").alias("task_id"), "page_count", F.lit(config.backend).alias("backend")
        ).alias("document_meta"),
        F.struct(
            "ocr_restructure_fallback",
            F.col("_length").alias("document_text_length"),
            F.col("_chunks").alias("chunk_count"),
            F.col("_sections").alias("relation_section_count"),
            planned_count.alias("relation_batch_count"),
            F.size(found).alias("relation_count"),
            skills.alias("selected_skills"),
        ).alias("ocr_summary"),
        "document_text",
        "chunks",
        settings.alias("relation_split_config"),
        F.col("sections").alias("relation_sections"),
        "relation_batches",
        F.struct(
            skills.alias("selected_skills"),
            F.coalesce("document_selected_skills", none).alias("document_selected_skills"),
            F.map_from_entries(
                F.transform("scores", lambda s: F.struct(F.concat(F.lit("batch-"), s["batch_index"]), s["scores"]))
            ).alias("scores"),
            F.lit("section_batched").alias("router_mode"),
            F.coalesce("cache_hit", F.lit(True)).alias("cache_hit"),
            "chunk_routes",
        ).alias("routing"),
        "proofreading",
        "chunk_predictions",
        found.alias("final_relation_list"),
        F.struct(found.alias("relation_list")).alias("prediction"),
    )
