"""Layout shaping (O), provenance and roll-ups (V), sources and sinks (S, K), tasks (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    BLOCKS,
    LEXICON,
    LINES,
    RANKED,
    RELATIONS,
    SECTION_STARTS,
    STATUS,
    block_docs,
    lexicon_skills,
    outline_docs,
    page_docs,
    q,
    relation_docs,
    scores_ctes,
    sql_compact,
    sql_strip,
    sql_tokens,
    stage_changes,
    table,
    with_ctes,
    work_dir,
)
from catalog.registry import query
from catalog.routing_queries import NEEDS
from catalog.section_queries import CHAPTERS, FLAT_SQL, MAX_TOKENS, PARAGRAPHS, _fixed, _guarded, flat, sections
from catalog.text_queries import _pieces, sql_clean_images, sql_sentences
from relmill.config import RunConfig, SplitConfig
from relmill.functions.text import doc_hash, let
from relmill.operators import batches as B
from relmill.operators import layout as O
from relmill.operators import provenance as V
from relmill.operators import relations as M
from relmill.operators import rollups as U
from relmill.operators import routing as G
from relmill.operators import skills as R
from relmill.operators import text as T
from relmill.operators.responses import RELATION_TYPE
from relmill.operators.sections import build_sections
from relmill.plans import corpus, product
from relmill.sources import scans as S
from relmill.sources import sinks as K
from relmill.streaming import tasks as W

NL2 = "chr(10) || chr(10)"
NAMES = list(LEXICON)


# ---- layout -------------------------------------------------------------------------------
@query(
    "o1_infer_block_pages",
    with_ctes(*BLOCKS)
    + """SELECT doc_id, CAST(i AS INTEGER) AS block_ord, CAST(block_key AS INTEGER) AS block_key,
      CAST(page AS INTEGER) AS page FROM paged""",
)
def infer_block_pages(spark, sf_dir):
    return O.infer_block_pages(block_docs(spark, sf_dir))


@query(
    "o2_filter_text_blocks",
    with_ctes(*BLOCKS)
    + "SELECT doc_id, CAST(i AS INTEGER) AS block_ord, label AS block_label, content AS block_content FROM texts",
)
def filter_text_blocks(spark, sf_dir):
    return O.filter_text_blocks(block_docs(spark, sf_dir)).select(
        "doc_id", "block_ord", "block_label", "block_content"
    )


# blocks without a global id are looked up by their own id, which is the block number here
PAGE_TEXTS = f"""page_texts AS (SELECT doc_id, page AS page_index, string_agg(body, {NL2} ORDER BY i) AS markdown_text
  FROM texts GROUP BY doc_id, page)"""
BOUNDED = """bounded AS (SELECT t.* FROM page_texts t WHERE page_index >= 1 AND page_index <=
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 + 1 ELSE 1000000 END)"""


@query(
    "o3_pages_from_blocks",
    with_ctes(*BLOCKS, PAGE_TEXTS, BOUNDED)
    + "SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, markdown_text FROM bounded",
)
def pages_from_blocks(spark, sf_dir):
    return O.pages_from_blocks(block_docs(spark, sf_dir)).drop("pruned_result")


@query(
    "o4_paragraphs_from_blocks",
    with_ctes(*BLOCKS)
    + """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS paragraph_ord,
      CAST(page AS INTEGER) AS page, label, body AS content, CAST(block_key AS INTEGER) AS global_block_id,
      CAST(group_id AS INTEGER) AS group_id, CAST(global_group_id AS INTEGER) AS global_group_id,
      CAST(i AS DOUBLE) AS bbox_left FROM texts""",
)
def paragraphs_from_blocks(spark, sf_dir):
    rows = O.paragraphs_from_blocks(block_docs(spark, sf_dir))
    return rows.withColumn("bbox_left", F.get("bbox", F.lit(0))).drop("bbox")


@query(
    "o5_layout_pages",
    with_ctes(*BLOCKS, PAGE_TEXTS, BOUNDED)
    + "SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, markdown_text AS text, 0 AS n_images FROM bounded",
)
def layout_pages(spark, sf_dir):
    return O.layout_pages(block_docs(spark, sf_dir)).select(
        "doc_id", "page_index", "markdown.text",
        F.when(F.col("markdown.images").isNull(), 0).otherwise(F.size("markdown.images")).alias("n_images"),
    )


def restructured_docs(spark, sf_dir):
    """Pages plus a restructured result whose text sits in a different place per document."""
    d = F.col("doc_id") % 6
    pages = page_docs(spark, sf_dir).select(
        "doc_id",
        F.when(d == 5, F.array().cast(f"array<{O.PAGE_TYPE}>")).otherwise(
            F.transform(
                "pages",
                lambda p: F.struct(
                    p["page_index"].alias("page_index"), F.lit("{}").alias("pruned_result"),
                    F.concat(F.lit("![x](y) "), p["text"]).alias("markdown_text"),
                ),
            )
        ).alias("pages"),
        F.transform("pages", lambda p: p["text"]).alias("texts"),
    )
    none = F.lit(None).cast("string")

    def page_result(t):
        markdown = F.struct(
            none.alias("markdownText"), F.lit("").alias("text"), t.alias("content"),
            F.lit(None).cast("map<string,string>").alias("images"),
        )
        return F.struct(
            none.alias("prunedResult"), F.when(d != 3, markdown).alias("markdown"), none.alias("markdownText"),
            t.alias("text"),
        )

    whole = F.array_join("texts", "\n")
    result = F.struct(
        F.when(d == 1, whole).otherwise("").alias("markdownText"),
        none.alias("markdown"),
        F.when(d == 0, "<img src=1>").alias("text"),
        F.transform("texts", page_result).alias("layoutParsingResults"),
    )
    return pages.withColumn("restructured", F.when(d != 4, result)).drop("texts")


RESTRUCTURED = (
    LINES,
    "page_in AS (SELECT doc_id, i, CASE WHEN i % 7 = 6 THEN ' ' || chr(10) ELSE p END AS t FROM lines)",
    f"""joined AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS whole,
      string_agg({sql_strip('t')}, {NL2} ORDER BY i) FILTER ({sql_strip('t')} <> '') AS blocks,
      string_agg('![x](y) ' || t, {NL2} ORDER BY i) AS pages,
      string_agg({sql_strip('t')}, {NL2} ORDER BY i) FILTER ({sql_strip('t')} <> '') AS cleaned,
      count(*) AS n FROM page_in GROUP BY doc_id)""",
    """docs_in AS (SELECT d.doc_id, j.* EXCLUDE (doc_id) FROM documents d LEFT JOIN joined j USING (doc_id))""",
)


@query(
    "o6_restructured_or_pages",
    with_ctes(*RESTRUCTURED)
    + f"""SELECT doc_id, coalesce({sql_strip('''CASE doc_id % 6 WHEN 0 THEN '<img src=1>' WHEN 1 THEN whole
      WHEN 4 THEN pages ELSE blocks END''')}, '') AS markdown_text FROM docs_in""",
)
def restructured_or_pages(spark, sf_dir):
    return O.restructured_or_pages(restructured_docs(spark, sf_dir)).select("doc_id", "markdown_text")


O7_TEXT = "CASE doc_id % 6 WHEN 0 THEN '<img src=1>' WHEN 1 THEN whole WHEN 4 THEN pages ELSE blocks END"


@query(
    "o7_assemble_document",
    with_ctes(
        *RESTRUCTURED,
        f"""page_clean AS (SELECT doc_id, string_agg(c, {NL2} ORDER BY i) FILTER (c <> '') AS kept FROM (
          SELECT doc_id, i, {sql_clean_images("'![x](y) ' || t")} AS c FROM page_in) GROUP BY doc_id)""",
        f"""texts_out AS (SELECT doc_id, n, {sql_clean_images(O7_TEXT)} AS t, kept FROM docs_in LEFT JOIN page_clean USING (doc_id))""",
    )
    + """SELECT doc_id, CASE WHEN doc_id % 6 = 5 OR n IS NULL THEN NULL WHEN t <> '' THEN t ELSE coalesce(kept, '') END AS document_text,
      CASE WHEN doc_id % 6 <> 5 AND n > 0 THEN doc_id % 6 = 4 END AS ocr_restructure_fallback,
      CAST(CASE WHEN doc_id % 6 <> 5 THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS page_count,
      CASE WHEN doc_id % 6 = 5 OR n IS NULL THEN 'no pages recognised' END AS error FROM texts_out""",
)
def assemble_document(spark, sf_dir):
    return O.assemble_document(restructured_docs(spark, sf_dir))


@query(
    "o7_assembly_outcome",
    with_ctes(*RESTRUCTURED)
    + """SELECT doc_id, CASE WHEN doc_id % 6 <> 5 AND n > 0 THEN doc_id % 6 = 4 END AS ocr_restructure_fallback,
      CAST(CASE WHEN doc_id % 6 <> 5 THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS page_count,
      CASE WHEN doc_id % 6 = 5 OR n IS NULL THEN 'no pages recognised' END AS error FROM docs_in""",
)
def assembly_outcome(spark, sf_dir):
    return O.assemble_document(restructured_docs(spark, sf_dir)).drop("document_text")


# ---- provenance -----------------------------------------------------------------------------
def batch_relations(spark, sf_dir, together: bool = False):
    """Chapter batches with one relation per paragraph of their sections.

    ``together``: the texts are dealt out by document first, so that what is grouped by document
    later needs no shuffle, when every relation holds copies of its paragraphs.
    """

    def relation(p, j):
        words = F.split(p["content"], " +")
        lost = j % 5 == 4
        evidence = (
            F.when(lost | (j % 3 == 1), "").when(j % 3 == 2, F.concat(F.lit("x"), p["content"])).otherwise(p["content"])
        )
        return F.struct(
            F.when(lost, "no head").otherwise(F.get(words, F.lit(0))).alias("head"),
            F.concat(F.lit("r"), (j % 2).cast("string")).alias("relation"),
            F.when(lost, "no tail").otherwise(F.element_at(words, -1)).alias("tail"),
            evidence.alias("evidence"),
            F.lit("en").alias("skill"),
        )

    outline = outline_docs(spark, sf_dir, dealt=together)
    rows = B.index_batches(B.batch_chapters(build_sections(outline, "text", True, keep=("doc_id", "text"))))
    relations = F.flatten(F.transform("sections", lambda s: F.transform(s["paragraphs"], relation)))
    return rows.withColumn("relations", relations)


BATCH_RELATIONS = (
    *SECTION_STARTS,
    *CHAPTERS,
    """batch_bodies AS (SELECT b.doc_id, c.run - 1 AS batch_index, b.section_ord, h.section_id, b.i, b.p, c.section_ids,
      row_number() OVER (PARTITION BY b.doc_id, b.section_ord ORDER BY b.i) - 1 AS j,
      row_number() OVER (PARTITION BY b.doc_id, c.run ORDER BY b.section_ord, b.i) - 1 AS relation_ord
      FROM bodies b JOIN heads h USING (doc_id, section_ord) JOIN chapters c ON c.doc_id = b.doc_id
        AND b.section_ord >= c.first_ord AND b.section_ord < c.first_ord + c.n_sections)""",
    """brel AS (SELECT *, CASE WHEN j % 5 = 4 THEN 'no head' ELSE string_split_regex(p, ' +')[1] END AS head,
      'r' || (j % 2) AS relation, CASE WHEN j % 5 = 4 THEN 'no tail' ELSE string_split_regex(p, ' +')[-1] END AS tail,
      CASE WHEN j % 5 = 4 OR j % 3 = 1 THEN '' WHEN j % 3 = 2 THEN 'x' || p ELSE p END AS evidence FROM batch_bodies)""",
    f"""section_texts AS (SELECT doc_id, section_ord, {sql_compact('text')} AS sc FROM sections)""",
    f"""matches AS (SELECT r.doc_id, r.batch_index, r.relation_ord, b.section_ord, b.section_id, b.i, b.p AS content,
      row_number() OVER (PARTITION BY r.doc_id, r.batch_index, r.relation_ord ORDER BY b.section_ord, b.i) - 1 AS match_ord
      FROM brel r JOIN batch_bodies b USING (doc_id, batch_index) JOIN section_texts s
        ON s.doc_id = b.doc_id AND s.section_ord = b.section_ord
      WHERE (r.evidence <> '' AND contains({sql_compact('b.p')}, {sql_compact('r.evidence')}))
        OR (contains(b.p, r.head) AND contains(b.p, r.tail))
        OR (r.evidence <> '' AND contains(s.sc, {sql_compact('r.evidence')}) AND (contains(b.p, r.head) OR contains(b.p, r.tail))))""",
)


@query(
    "v1_match_paragraphs",
    with_ctes(*BATCH_RELATIONS)
    + """SELECT doc_id, CAST(batch_index AS INTEGER) AS batch_index, CAST(relation_ord AS INTEGER) AS relation_ord,
      CAST(match_ord AS INTEGER) AS match_ord, section_id, content FROM matches""",
)
def match_paragraphs(spark, sf_dir):
    return V.match_paragraphs(batch_relations(spark, sf_dir)).drop("page", "global_block_id", "bbox")


ATTACHED = (
    *BATCH_RELATIONS,
    """matched AS (SELECT doc_id, batch_index, relation_ord, string_agg(section_id, ',' ORDER BY m) AS ids, sum(n) AS n FROM (
      SELECT doc_id, batch_index, relation_ord, section_id, min(match_ord) AS m, count(*) AS n FROM matches GROUP BY ALL)
      GROUP BY ALL)""",
)


@query(
    "v2_attach_sources",
    with_ctes(*ATTACHED)
    + """SELECT r.doc_id, CAST(r.batch_index AS INTEGER) AS batch_index, CAST(r.relation_ord AS INTEGER) AS relation_ord,
      array_to_string(CASE WHEN m.ids IS NULL THEN string_split(section_ids, ',') ELSE string_split(m.ids, ',') END, ',') AS sections,
      CASE WHEN m.ids IS NULL THEN '1' ELSE '' END AS pages, CAST(coalesce(m.n, 0) AS INTEGER) AS n_paragraphs
      FROM brel r LEFT JOIN matched m USING (doc_id, batch_index, relation_ord)""",
)
def attach_sources(spark, sf_dir):
    return V.attach_sources(batch_relations(spark, sf_dir)).select(
        "doc_id", "batch_index", "relation_ord", F.array_join("source_sections", ",").alias("sections"),
        F.array_join("source_pages", ",").alias("pages"), F.size("source_paragraphs").alias("n_paragraphs"),
    )


@query(
    "v3_dedup_document",
    with_ctes(
        *ATTACHED,
        f"""vkeys AS (SELECT *, lower({sql_compact('head')}) AS kh, lower({sql_compact('relation')}) AS kr,
          lower({sql_compact('tail')}) AS kt, lower({sql_compact('evidence')}) AS ke, batch_index * 1000000 + relation_ord AS pos_at FROM brel)""",
        """vfirst AS (SELECT doc_id, kh, kr, kt, ke, arg_min(head, pos_at) AS head, arg_min(relation, pos_at) AS relation,
          arg_min(tail, pos_at) AS tail, arg_min(evidence, pos_at) AS evidence, min(pos_at) AS pos_at FROM vkeys GROUP BY ALL)""",
        """vsources AS (SELECT k.doc_id, kh, kr, kt, ke, m.section_id AS sid, k.pos_at * 10000 + m.match_ord AS pos,
            m.section_id || '|' || m.content AS par FROM vkeys k JOIN matches m USING (doc_id, batch_index, relation_ord)
          UNION ALL SELECT k.doc_id, kh, kr, kt, ke, unnest(string_split(section_ids, ',')), k.pos_at * 10000
            + unnest(range(0, len(string_split(section_ids, ',')))), NULL
            FROM vkeys k ANTI JOIN matches m USING (doc_id, batch_index, relation_ord))""",
        """vsections AS (SELECT doc_id, kh, kr, kt, ke, string_agg(sid, ',' ORDER BY pos) AS sections FROM (
          SELECT doc_id, kh, kr, kt, ke, sid, min(pos) AS pos FROM vsources GROUP BY ALL) GROUP BY ALL)""",
        """vpars AS (SELECT doc_id, kh, kr, kt, ke, count(DISTINCT par) AS n FROM vsources GROUP BY ALL)""",
    )
    + """SELECT doc_id, head, relation, tail, evidence, CAST(pos_at // 1000000 AS INTEGER) AS source_batch_index, sections,
      CAST(n AS INTEGER) AS n_paragraphs FROM vfirst JOIN vsections USING (doc_id, kh, kr, kt, ke) JOIN vpars USING (doc_id, kh, kr, kt, ke)""",
)
def dedup_document(spark, sf_dir):
    attached = V.attach_sources(batch_relations(spark, sf_dir, together=True)).drop("batch_index")
    return V.dedup_document(attached).select(
        "doc_id", "head", "relation", "tail", "evidence", "source_batch_index",
        F.array_join("source_sections", ",").alias("sections"), F.size("source_paragraphs").alias("n_paragraphs"),
    )


# ---- roll-ups ---------------------------------------------------------------------------------
def batch_results(spark, sf_dir):
    name = lambda n: F.get(F.array(*map(F.lit, NAMES)), n.cast("int"))
    d, b = F.col("doc_id"), F.col("batch_index")
    return batch_relations(spark, sf_dir).withColumns(
        {
            "selected_skills": F.array(name((b + d) % 5), name(b * 2 % 5)),
            "document_selected_skills": F.array(name(d % 5)),
            "scores": F.array(F.struct(name(b % 5).alias("skill"), F.lit(0).alias("ord"), F.lit(1.0).alias("score"))),
            "cache_hit": b % 4 != 3,
        }
    )


BATCH_RESULTS = (
    *BATCH_RELATIONS,
    f"""results AS (SELECT doc_id, CAST(batch_index AS BIGINT) AS batch_index, any_value(section_ids) AS section_ids, count(*) AS n_relations,
      [{", ".join(map(q, NAMES))}] AS names FROM brel GROUP BY brel.doc_id, brel.batch_index)""",
)


@query(
    "v4_rollup_batches",
    with_ctes(
        *BATCH_RESULTS,
        """named AS (SELECT doc_id, batch_index * 2 AS pos, names[(batch_index + doc_id) % 5 + 1] AS s FROM results
          UNION ALL SELECT doc_id, batch_index * 2 + 1, names[batch_index * 2 % 5 + 1] FROM results)""",
        """skills AS (SELECT doc_id, string_agg(s, ',' ORDER BY pos) AS skills FROM (
          SELECT doc_id, s, min(pos) AS pos FROM named GROUP BY ALL) GROUP BY doc_id)""",
    )
    + """SELECT doc_id, count(*) AS batch_count, CAST(sum(n_relations) AS BIGINT) AS relation_count,
      bool_and(batch_index % 4 <> 3) AS cache_hit, any_value(skills) AS skills, any_value(names[doc_id % 5 + 1]) AS document_skills
      FROM results JOIN skills USING (doc_id) GROUP BY doc_id""",
)
def rollup_batches(spark, sf_dir):
    return U.rollup_batches(batch_results(spark, sf_dir)).select(
        "doc_id", "batch_count", "relation_count", "cache_hit", F.array_join("selected_skills", ",").alias("skills"),
        F.array_join("document_selected_skills", ",").alias("document_skills"),
    )


@query(
    "v4_batch_summary",
    with_ctes(*BATCH_RESULTS)
    + """SELECT doc_id, CAST(batch_index AS INTEGER) AS batch_index, 'batch-' || batch_index AS batch_key, 'chapter' AS split_mode,
      section_ids, names[batch_index % 5 + 1] || '=1.0' AS scores, CAST(n_relations AS INTEGER) AS relation_count FROM results""",
)
def batch_summary(spark, sf_dir):
    scores = F.array_join(F.transform("scores", lambda s: F.concat(s["skill"], F.lit("="), s["score"].cast("string"))), ",")
    return U.batch_summary(batch_results(spark, sf_dir)).withColumns(
        {"scores": scores, "section_ids": F.array_join("section_ids", ",")}
    )


@query(
    "v5_sum_metrics",
    "SELECT user_id, "
    + ", ".join(
        f"round(sum(coalesce(CASE WHEN event_id % {i + 2} <> 0 THEN value * {i + 1} END, 0)), 4) AS {c}"
        for i, c in enumerate(U.TIMINGS)
    )
    + ", "
    + ", ".join(
        f"CAST(sum(coalesce(CASE WHEN event_id % {i + 3} <> 1 THEN event_id % 7 END, 0)) AS BIGINT) AS {c}"
        for i, c in enumerate(U.COUNTS)
    )
    + " FROM events GROUP BY user_id",
)
def sum_metrics(spark, sf_dir):
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        "user_id",
        *[F.when(e % (i + 2) != 0, F.col("value") * (i + 1)).alias(c) for i, c in enumerate(U.TIMINGS)],
        *[F.when(e % (i + 3) != 1, e % 7).alias(c) for i, c in enumerate(U.COUNTS)],
    )
    return U.sum_metrics(events, ("user_id",))


@query(
    "v6_document_summary",
    with_ctes(*BATCH_RESULTS, RELATIONS)
    + """SELECT d.doc_id, CAST(d.doc_id % 4 AS BIGINT) AS page_count, d.doc_id % 3 = 0 AS ocr_restructure_fallback,
      CAST(length(d.text) AS INTEGER) AS document_text_length, d.lang AS skills, coalesce(c.n, 0) AS chunk_count,
      coalesce(s.n, 0) AS relation_section_count, coalesce(b.n, 0) AS relation_batch_count, coalesce(r.n, 0) AS relation_count
      FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) c USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM sections GROUP BY doc_id) s USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM results GROUP BY doc_id) b USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM rel GROUP BY doc_id) r USING (doc_id)""",
)
def document_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    documents = docs.select(
        "doc_id", (F.col("doc_id") % 4).alias("page_count"), (F.col("doc_id") % 3 == 0).alias("ocr_restructure_fallback"),
        F.col("text").alias("document_text"), F.array("lang").alias("selected_skills"),
    )
    chunks = T.split_paragraphs(docs, pattern="\n")
    with_sections = sections(spark, sf_dir)
    section_rows = with_sections.select("doc_id", F.explode("sections").alias("s"))
    batches = B.index_batches(B.batch_chapters(with_sections))
    relations = M.explode_relations(relation_docs(spark, sf_dir))
    summary = U.document_summary(documents, chunks, section_rows, batches, relations)
    return summary.withColumn("skills", F.array_join("selected_skills", ",")).drop("selected_skills")


def run_tables(spark, sf_dir):
    samples = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.array("lang", "source").alias("selected_skills"),
        (F.col("n_chars") / 1000).alias("total_seconds"), (F.col("n_chars") / 500).alias("sample_wall_seconds"),
    )
    relations = M.explode_relations(relation_docs(spark, sf_dir)).withColumnRenamed("doc_id", "sample_id")
    return samples, relations


RUN = """run AS (SELECT doc_id AS sample_id, lang || ',' || source AS skills, coalesce(n, 0) AS relation_count,
  n_chars / 1000 AS total_seconds, n_chars / 500 AS sample_wall_seconds FROM documents
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM rel GROUP BY doc_id) USING (doc_id))"""


@query("v7_run_summary", with_ctes(RELATIONS, RUN) + "SELECT * FROM run")
def run_summary(spark, sf_dir):
    return U.run_summary(*run_tables(spark, sf_dir))


@query(
    "v7_run_totals",
    with_ctes(RELATIONS, RUN)
    + """SELECT count(*) AS sample_count, CAST(sum(relation_count) AS BIGINT) AS relation_count,
      round(sum(total_seconds), 4) AS total_seconds, round(sum(sample_wall_seconds), 4) AS total_wall_seconds FROM run""",
)
def run_totals(spark, sf_dir):
    return U.run_totals(run_summary(spark, sf_dir))


def result_table(spark, sf_dir):
    columns = [c for view in U.VIEWS.values() for c in view]
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("task_id"),
        *[F.concat(F.lit(f"{c} of "), F.col("source")).alias(c) for c in columns],
    )


for _kind, _columns in U.VIEWS.items():
    query(
        f"v8_result_view_{_kind}",
        "SELECT doc_id AS task_id, " + ", ".join(f"'{c} of ' || source AS {c}" for c in _columns) + " FROM documents",
    )(lambda spark, sf_dir, kind=_kind: U.result_view(result_table(spark, sf_dir), kind))


@query("v9_order_fields", with_ctes(RELATIONS) + "SELECT * REPLACE (CAST(relation_ord AS INTEGER) AS relation_ord) FROM rel")
def order_fields(spark, sf_dir):
    rows = M.explode_relations(relation_docs(spark, sf_dir))
    return U.order_fields(rows.select(*sorted(rows.columns, reverse=True)))


# ---- whole run --------------------------------------------------------------------------------
def recorded_replies(chunks):
    """A reply per chunk: the first and last word of each of its sentences, as the model would answer."""

    def item(words):
        first, last = F.element_at(words, 1), F.element_at(words, -1)
        return F.concat(
            F.lit('{"head":"'), first, F.lit('","relation":"位于","tail":"'), last, F.lit('","evidence":"'),
            F.array_join(words, " "), F.lit('","skill":"'), F.element_at("selected_skills", 1), F.lit('"}'),
        )

    sentences = F.transform(
        F.split("chunk_text", "[.!?\n]+"), lambda s: F.filter(F.split(F.regexp_replace(s, "[^A-Za-z ]", ""), " +"), lambda w: w != "")
    )
    items = F.transform(F.filter(sentences, lambda w: F.size(w) >= 2), item)
    return chunks.select("prompt_id", F.concat(F.lit('{"relation_list":['), F.array_join(items, ","), F.lit("]}")).alias("reply"))


@query("v10_extract_corpus")
def extract_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    skills, config = lexicon_skills(), RunConfig(chunk_trigger=200, chunk_budget=100)
    prepared = corpus.prepare(docs, skills, config)
    relations, _ = corpus.finish(prepared.documents, prepared.chunks, recorded_replies(prepared.chunks), skills, config)
    return relations


@query("v10_prompt_table")
def prompt_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.prepare(docs, lexicon_skills(), RunConfig(chunk_trigger=200, chunk_budget=100)).prompts


# ---- product run ------------------------------------------------------------------------------
SPLIT = SplitConfig(max_batch_tokens=MAX_TOKENS)
SMALL_BATCHES = (*SECTION_STARTS, *PARAGRAPHS, _fixed(1, "singles"), *_guarded("singles", "small_section"))


def product_intake(spark, sf_dir):
    """Layout results with one page per paragraph, nothing restructured."""
    outline = outline_docs(spark, sf_dir)
    page = lambda t, i: F.struct((i + 1).alias("page_index"), F.lit("{}").alias("pruned_result"), t.alias("markdown_text"))
    layout = outline.select(
        "doc_id", F.transform(F.split("text", "\n\n"), page).alias("pages"),
        F.lit(None).cast(restructured_docs(spark, sf_dir).schema["restructured"].dataType).alias("restructured"),
    )
    return product.intake(layout, SPLIT)


@query("v10_product_batches", with_ctes(*SMALL_BATCHES) + FLAT_SQL)
def product_batches(spark, sf_dir):
    return flat(product_intake(spark, sf_dir).batches)


@query(
    "v10_product_prompts",
    with_ctes(
        *SMALL_BATCHES,
        """units AS (SELECT doc_id || '/' || (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) AS doc_id, text FROM final)""",
        *scores_ctes("units", "doc_id", "text"),
        RANKED,
        NEEDS,
        f"""asks AS (SELECT doc_id, text, s1 < 3 OR (s2 >= 1 AND s1 - s2 < 1) AS routed, {sql_tokens('text')} > 30 AS long
          FROM units JOIN needs USING (doc_id))""",
    )
    + """SELECT min(doc_id) AS unit_id, 'router' AS kind, 4200 AS max_tokens FROM asks WHERE routed GROUP BY text
      UNION ALL SELECT doc_id, 'coref', 4200 FROM asks WHERE long
      UNION ALL SELECT doc_id, 'extraction', 4200 FROM asks WHERE NOT routed AND NOT long""",
)
def product_prompts(spark, sf_dir):
    """What the first turn asks: a batch without open routes and aliases is extracted at once."""
    config = RunConfig(chunk_trigger=30, chunk_budget=20, backend="other")
    turn = product.advance(product_intake(spark, sf_dir), lexicon_skills(), config)
    return turn.prompts.select("unit_id", "kind", "max_tokens")


@query("v10_document_results")
def document_results(spark, sf_dir):
    """The last turn: every prompt has its reply, and batches become documents."""
    taken = product_intake(spark, sf_dir)
    unit = F.col("unit_id")
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " +"), lambda w: w != "")
    item = lambda w: F.to_json(
        F.struct(
            F.get(w, F.lit(0)).alias("head"), F.lit("位于").alias("relation"), F.element_at(w, -1).alias("tail"),
            F.substring_index("text", "\n", 1).alias("evidence"), F.lit("english").alias("skill"),
        )
    )
    # the words of a text are looked for once
    reply = let(words, lambda w: F.concat(F.lit('{"relation_list":['), F.when(F.size(w) > 1, item(w)).otherwise(""), F.lit("]}")))
    prompts = {
        "router": (F.concat(F.lit("router/"), doc_hash(F.col("text"))), F.lit(None).cast("string")),
        "extraction": (
            corpus.prompt_key("extraction", unit, F.lit(0)),
            reply,
        ),
    }
    answers = F.array(*[F.struct(i.alias("prompt_id"), F.lit(k).alias("kind"), r.alias("reply")) for k, (i, r) in prompts.items()])
    ledger = taken.batches.select(F.inline(answers))
    config = RunConfig(chunk_trigger=1_000_000, fast_mode=True)
    turn = product.advance(taken, lexicon_skills(), config, ledger)
    return product.document_results(taken, turn.batches, SPLIT, config).select(
        "task_id", "stage", "error", "document_meta.page_count", "ocr_summary.relation_section_count", "ocr_summary.relation_batch_count",
        "ocr_summary.relation_count", F.array_join("routing.selected_skills", ",").alias("skills"),
        F.to_json("final_relation_list").alias("relations"),
    )


# ---- sources --------------------------------------------------------------------------------
def nation_skills(spark, sf_dir):
    """One skill per nation, its keywords the market segments of its customers."""
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    grouped = customers.groupBy(F.regexp_replace("n_name", "[^A-Za-z0-9]", "_").alias("name")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("c_mktsegment")).alias("keywords")
    )
    example = F.struct(
        F.col("name").alias("text"), F.lit('{"relation_list":[{"head":"a"}]}').alias("json"),
        F.lit(None).cast("boolean").alias("is_document_level"),
    )
    return grouped.select(
        "name", F.concat(F.col("n"), F.lit(" customers")).alias("description"),
        *[F.lit("v").alias(c) for c in R.REQUIRED_STRINGS[2:]],
        F.array(F.lit("rule")).alias("extraction_rules"), "keywords", F.array(example).alias("fewshot"),
    )


def skill_folder(spark, sf_dir):
    path = work_dir(spark)
    named = nation_skills(spark, sf_dir).withColumn("file", F.col("name"))
    named.repartition("file").write.partitionBy("file").json(path)
    return path


@query(
    "s1_scan_uploads",
    "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS length, 32 AS task_id_chars FROM documents GROUP BY source",
)
def scan_uploads(spark, sf_dir):
    path = work_dir(spark)
    docs = table(spark, sf_dir, "documents").select("source", F.col("text").alias("value"))
    docs.repartition("source").write.partitionBy("source").text(path)
    files = S.scan_uploads(spark, path)
    folder = F.regexp_extract("path", "source=([^/]+)", 1)
    return files.select(folder.alias("source"), "length", F.char_length("task_id").alias("task_id_chars"))


@query(
    "s2_classify_files",
    """WITH f AS (SELECT doc_id, ['a.PDF','b.txt','.png','c.tar.webp','noext','d.'][CAST(doc_id % 6 AS INT) + 1] AS name,
      [NULL,'.pdf','.png','.jpg','.bmp','.webp',NULL][CAST(doc_id % 7 AS INT) + 1] AS sniffed,
      ['.pdf',NULL,NULL,'.webp',NULL,NULL][CAST(doc_id % 6 AS INT) + 1] AS own FROM documents)
    SELECT doc_id, CASE WHEN own IS NOT NULL THEN name WHEN sniffed IS NOT NULL THEN name || sniffed ELSE 'rejected' END AS stored_filename,
      CAST(CASE coalesce(own, sniffed) WHEN '.pdf' THEN 0 ELSE CASE WHEN coalesce(own, sniffed) IS NULL THEN -1 ELSE 1 END END AS INTEGER) AS file_type FROM f""",
)
def classify_files(spark, sf_dir):
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % n).cast("int"))
    names = ("a.PDF", "b.txt", ".png", "c.tar.webp", "noext", "d.")
    heads = ("00", "255044462D", "89504E470D0A1A0A", "FFD8FF", "424D", "524946460000000057454250", "5249464600")
    files = table(spark, sf_dir, "documents").select(
        "doc_id", pick(names, 6).alias("filename"),
        F.concat(F.unhex(pick(heads, 7)), F.encode("text", "UTF-8")).alias("content"),
    )
    known, unknown = S.classify_files(files)
    return known.select("doc_id", "stored_filename", "file_type").unionByName(
        unknown.select("doc_id", F.lit("rejected").alias("stored_filename"), F.lit(-1).alias("file_type"))
    )


def sample_file(spark, sf_dir):
    """JSON lines in document order over several files; every fifth text missing."""
    path = work_dir(spark)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("s"), F.col("doc_id")).alias("sample_id"), F.struct("lang", "source").alias("input"),
                F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("output"),
            )
        ).alias("value"),
    )
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return path


SAMPLES = """samples AS (SELECT count(*) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 1 AS sample_index, 's' || doc_id AS sample_id, lang, source,
  CASE WHEN doc_id % 5 <> 0 THEN text ELSE '' END AS doc_text FROM documents)"""


def _flat_samples(df):
    return df.select(
        "sample_index", "sample_id", F.col("input_meta")["lang"].alias("lang"), F.col("input_meta")["source"].alias("source"),
        "doc_text",
    )


@query("s3_scan_samples", with_ctes(SAMPLES) + "SELECT * FROM samples")
def scan_samples(spark, sf_dir):
    return _flat_samples(S.scan_samples(spark, sample_file(spark, sf_dir)))


@query("s3_scan_samples_limit", with_ctes(SAMPLES) + "SELECT * FROM samples WHERE sample_index < 120")
def scan_samples_limit(spark, sf_dir):
    return _flat_samples(S.scan_samples(spark, sample_file(spark, sf_dir), 120))


@query(
    "s4_scan_samples_skip_empty",
    with_ctes(SAMPLES) + "SELECT * FROM samples WHERE doc_text <> '' ORDER BY sample_index LIMIT 120",
)
def scan_samples_skip_empty(spark, sf_dir):
    return _flat_samples(S.scan_samples(spark, sample_file(spark, sf_dir), 120, skip_empty=True))


NATION_SKILLS = """nat AS (SELECT regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g') AS name, count(*) || ' customers' AS description,
  string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS keywords FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)"""


@query(
    "s5_scan_skills",
    with_ctes(NATION_SKILLS)
    + "SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS skill_ord, name, description, keywords FROM nat",
)
def scan_skills(spark, sf_dir):
    skills = S.scan_skills(spark, skill_folder(spark, sf_dir))
    return skills.select("skill_ord", "name", "description", F.array_join("keywords", ",").alias("keywords"))


def layout_folder(spark, sf_dir):
    """Layout results as JSON lines: blocks for even documents, pages for odd ones."""
    path = work_dir(spark)
    blocks = block_docs(spark, sf_dir)
    d = F.col("doc_id") % 4

    def page(b, i):
        t = F.coalesce(b["block_content"], F.lit(""))
        return F.struct(
            F.struct(
                F.when(i % 3 == 0, t).alias("markdownText"), F.when(i % 3 == 1, t).alias("text"),
                F.when(i % 6 == 2, t).alias("content"),
            ).alias("markdown"),
            F.when(i % 6 == 5, t).alias("markdownText"),
        )

    rows = blocks.select(
        F.col("doc_id").cast("string").alias("doc_id"), "page_count",
        F.when(d % 2 == 0, F.col("parsing_res_list")).alias("parsing_res_list"),
        F.when(d % 2 == 1, F.transform("parsing_res_list", page)).alias("layoutParsingResults"),
    )
    rows.write.json(path)
    return path


@query(
    "s6_scan_layout_results",
    with_ctes(*BLOCKS, PAGE_TEXTS, BOUNDED)
    + f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(page_index AS INTEGER) AS page_index, markdown_text FROM bounded WHERE doc_id % 2 = 0
      UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(i + 1 AS INTEGER), {sql_strip('content')} FROM blocks WHERE doc_id % 2 = 1""",
)
def scan_layout_results(spark, sf_dir):
    return S.scan_layout_results(spark, layout_folder(spark, sf_dir), multi_line=False).drop("pruned_result")


@query("s7_list_skills", with_ctes(NATION_SKILLS) + "SELECT name, description, keywords FROM nat")
def list_skills(spark, sf_dir):
    skills = S.list_skills(spark, skill_folder(spark, sf_dir))
    return skills.select("name", "description", F.array_join("keywords", ",").alias("keywords"))


@query("s7_get_skill", with_ctes(NATION_SKILLS) + "SELECT name, description FROM nat WHERE name = 'NATION_3'")
def get_skill(spark, sf_dir):
    return S.get_skill(spark, skill_folder(spark, sf_dir), "NATION_3").select("name", "description")


def fresh_routes(spark, sf_dir, label: str, known: str):
    """Routes of all documents; a text that is not ``known`` counts as another version of itself."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text", F.when(F.expr(known), F.col("text")).otherwise(F.concat(F.lit(f"{label}: "), F.col("text"))))
    route = F.struct(
        F.array("lang").alias("selected_skills"), F.lit(None).cast(G.SCORES_TYPE).alias("scores"),
        F.lit(label).alias("router_reason"), F.lit(G.MODE_RULE).alias("router_mode"),
    )
    return docs.groupBy(doc_hash(F.col("text")).alias("doc_hash")).agg(F.min_by(route, "doc_id").alias("route"))


ROUTE_LOG = """versions AS (
    SELECT CASE WHEN lang <> 'fr' THEN text ELSE 'first: ' || text END AS text, lang, doc_id, 1 AS n FROM documents
    UNION ALL SELECT CASE WHEN n_chars > 1000 THEN text ELSE 'second: ' || text END, lang, doc_id, 2 FROM documents),
  routes AS (SELECT sha256(text) AS doc_hash, arg_min(lang, doc_id) FILTER (n = 1) AS a,
    arg_min(lang, doc_id) FILTER (n = 2) AS b FROM versions GROUP BY text)"""
LATEST_ROUTES = """SELECT doc_hash, coalesce(b, a) AS skills, CASE WHEN b IS NULL THEN 'first' ELSE 'second' END AS reason FROM routes"""


def _flat_routes(df):
    return df.select(
        "doc_hash", F.array_join("route.selected_skills", ",").alias("skills"), F.col("route.router_reason").alias("reason")
    )


@query("s8_read_route_cache", with_ctes(ROUTE_LOG) + LATEST_ROUTES)
def read_route_cache(spark, sf_dir):
    path = work_dir(spark)
    K.write_route_cache(fresh_routes(spark, sf_dir, "first", "lang != 'fr'"), path)
    K.write_route_cache(fresh_routes(spark, sf_dir, "second", "n_chars > 1000"), path)
    return _flat_routes(S.read_route_cache(spark, path))


# ---- sinks ------------------------------------------------------------------------------------
def task_results(spark, sf_dir):
    docs = relation_docs(spark, sf_dir)
    return docs.select(
        F.col("doc_id").alias("task_id"), F.concat(F.lit(" \n"), F.col("text"), F.lit(" ")).alias("document_text"),
        F.when(F.col("doc_id") % 4 != 0, F.col("relations")).alias("paragraphs"), F.lit("x").alias("_pages_res"),
    )


@query(
    "k1_result_artifacts",
    with_ctes(RELATIONS)
    + f"""SELECT doc_id AS task_id, {sql_strip('text')} || chr(10) AS document_text,
      CAST(CASE WHEN doc_id % 4 <> 0 THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_paragraphs,
      {sql_strip('text')} || ' ' = {sql_strip('text')} AS has_private FROM documents
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM rel GROUP BY doc_id) USING (doc_id)""",
)
def result_artifacts(spark, sf_dir):
    parts = K.result_artifacts(task_results(spark, sf_dir))
    return parts.select(
        "task_id", "document_text", F.json_array_length("ocr_paragraphs").alias("n_paragraphs"),
        F.get_json_object("result_json", "$._pages_res").isNotNull().alias("has_private"),
    )


@query(
    "k1_write_results",
    with_ctes(NATION_SKILLS)
    + """SELECT name AS task_id, unnest(['document_text', 'ocr_paragraphs', 'result_json']) AS artefact,
      unnest([description || chr(10) || name || chr(10), '1 ' || name, description || chr(10) || name]) AS value FROM nat""",
)
def write_results(spark, sf_dir):
    """All three artefacts, read back."""
    path = work_dir(spark)
    nations = nation_skills(spark, sf_dir).select(
        F.col("name").alias("task_id"), F.concat_ws("\n", "description", "name").alias("document_text"), F.col("fewshot").alias("paragraphs")
    )
    paths = K.write_results(nations, path)
    value = F.col("value")
    read = {
        "document_text": (paths["document_text_md"], value),
        "ocr_paragraphs": (paths["ocr_paragraphs_json"], F.concat_ws(" ", F.json_array_length(value), F.get_json_object(value, "$[0].text"))),
        "result_json": (paths["result_json"], F.get_json_object(value, "$.document_text")),
    }
    parts = [
        spark.read.text(folder, wholetext=True).select("task_id", F.lit(name).alias("artefact"), shown.alias("value"))
        for name, (folder, shown) in read.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "k2_write_run_report",
    with_ctes(RELATIONS, RUN)
    + """SELECT 'vllm' AS backend, 'm' AS model, count(*) AS sample_count, round(sum(sample_wall_seconds), 4) AS total_wall_seconds,
      count(*) AS result_rows FROM run""",
)
def write_run_report(spark, sf_dir):
    summary = run_summary(spark, sf_dir)
    paths = K.write_run_report(summary, summary, work_dir(spark), "vllm", "m")
    meta = spark.read.schema("backend string, model string, sample_count long, total_wall_seconds double").json(paths["meta"])
    return meta.withColumn("result_rows", F.lit(spark.read.json(paths["results"]).count()).cast("long"))


@query("k3_write_route_cache", with_ctes(ROUTE_LOG) + LATEST_ROUTES)
def merge_routes(spark, sf_dir):
    old = fresh_routes(spark, sf_dir, "first", "lang != 'fr'").withColumn("written_at", F.lit(1))
    new = fresh_routes(spark, sf_dir, "second", "n_chars > 1000").withColumn("written_at", F.lit(2))
    return _flat_routes(K.merge_routes(old, new))


def _upserted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = lambda offset=0, kind=F.lit("s"): F.concat(kind, F.col("doc_id") + offset)
    german = F.when(F.col("lang") == "de", "t").otherwise("s")
    registry = docs.select(name(0, german).alias("name"), F.col("lang").alias("description"))
    d = F.col("doc_id")
    changes = docs.select(
        F.when(d % 5 == 0, F.concat(F.lit("new"), d)).when(d % 5 == 1, name(4)).otherwise(name()).alias("name"),
        F.col("source").alias("description"),
        F.when(d % 2 + d % 5 == 3, "create").otherwise("update").alias("action"),
        name(0, F.when(F.col("source") == "src0", "u").otherwise("s")).alias("target"),
    )
    return R.upsert_skills(registry, changes)


UPSERTS = """reg AS (SELECT CASE lang WHEN 'de' THEN 't' ELSE 's' END || doc_id AS name, lang AS description FROM documents),
  chg AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'new' || doc_id WHEN doc_id % 5 = 1 THEN 's' || (doc_id + 4) ELSE 's' || doc_id END AS name,
    source AS description, doc_id % 2 + doc_id % 5 = 3 AS creates, CASE source WHEN 'src0' THEN 'u' ELSE 's' END || doc_id AS target FROM documents),
  judged AS (SELECT *, CASE WHEN creates THEN CASE WHEN name IN (SELECT name FROM reg) THEN 'conflict' END
    WHEN target NOT IN (SELECT name FROM reg) THEN 'not found'
    WHEN target <> name AND name IN (SELECT name FROM reg) THEN 'conflict' END AS reason FROM chg)"""


@query(
    "k4_upsert_skills",
    with_ctes(UPSERTS)
    + """SELECT * FROM reg WHERE name NOT IN (SELECT target FROM judged WHERE reason IS NULL AND NOT creates)
      UNION ALL SELECT name, description FROM judged WHERE reason IS NULL""",
)
def upsert_skills(spark, sf_dir):
    return _upserted(spark, sf_dir)[0]


@query("k4_rejected_changes", with_ctes(UPSERTS) + "SELECT name, target, reason FROM judged WHERE reason IS NOT NULL")
def rejected_changes(spark, sf_dir):
    return _upserted(spark, sf_dir)[1].select("name", "target", "reason")


@query(
    "k5_export_document_json",
    with_ctes(RELATIONS)
    + """SELECT doc_id AS task_id, sha256(' ' || chr(10) || text || ' ') AS text_sha256, false AS has_private,
      CAST(relation_ord AS INTEGER) AS relation_ord, head, relation, tail, evidence, skill
      FROM documents LEFT JOIN (SELECT * FROM rel WHERE doc_id % 4 <> 0) USING (doc_id)""",
)
def export_document_json(spark, sf_dir):
    """The exported JSON, read back field by field."""
    shape = f"document_text string, paragraphs array<{RELATION_TYPE}>, _pages_res string"
    read = K.export_document_json(task_results(spark, sf_dir)).select("task_id", F.from_json("json", shape).alias("j"))
    return read.select(
        "task_id", F.sha2("j.document_text", 256).alias("text_sha256"), F.col("j._pages_res").isNotNull().alias("has_private"),
        F.posexplode_outer("j.paragraphs").alias("relation_ord", "r"),
    ).select("task_id", "text_sha256", "has_private", "relation_ord", "r.*")


# ---- tasks --------------------------------------------------------------------------------------
#: A pattern, as a stream takes a plain path for a folder: the table is one file or a folder of files.
DOCUMENT_FILES = "{}/{{documents.parquet}}"


@query(
    "w1_stream_documents",
    _pieces(sql_sentences("text"), "sentence", "sentence_ord", f"(SELECT * FROM documents WHERE {sql_strip('text')} <> '')"),
)
def stream_documents(spark, sf_dir):
    out, checkpoint = work_dir(spark), work_dir(spark)
    stream = W.stream_documents(
        spark, DOCUMENT_FILES.format(sf_dir), "doc_id long, text string, lang string, source string, n_chars long",
        lambda batch: T.split_sentences(batch), out, checkpoint,
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/results").drop("batch")


@query(
    "w1_failing_document",
    f"""SELECT CAST(doc_id AS VARCHAR) AS task_id, CASE WHEN doc_id = 1 OR {sql_strip('text')} = '' THEN 'failed' ELSE 'succeeded' END AS status,
      CAST(CASE WHEN doc_id = 1 OR {sql_strip('text')} = '' THEN 0 ELSE length(text) END AS INTEGER) AS n FROM documents""",
)
def failing_document(spark, sf_dir):
    """The transform raises on one document; the others have their results."""
    out, checkpoint = work_dir(spark), work_dir(spark)

    def transform(batch):
        n = F.when(F.col("doc_id") == 1, F.raise_error(F.lit("unreadable")).cast("int")).otherwise(F.char_length("text"))
        return batch.select(F.col("doc_id").cast("string").alias("task_id"), n.alias("n"))

    W.stream_documents(
        spark, DOCUMENT_FILES.format(sf_dir), "doc_id long, text string, lang string, source string, n_chars long",
        transform, out, checkpoint,
    ).awaitTermination()
    status = spark.read.parquet(f"{out}/status").select("task_id", "status")
    results = spark.read.parquet(f"{out}/results").select("task_id", "n")
    return status.join(results, "task_id", "left").fillna(0, ["n"])


@query(
    "w2_status_log",
    with_ctes(STATUS) + "SELECT task_id, stage, status, progress, error, result_ready, updated_at FROM log",
)
def status_log(spark, sf_dir):
    return W.status_log(stage_changes(spark, sf_dir))


LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC, event_id DESC) AS rn,
  min(updated_at) OVER (PARTITION BY task_id) AS created_at FROM log) WHERE rn = 1)"""


def latest(spark, sf_dir):
    changes = stage_changes(spark, sf_dir)
    # the event number settles equal timestamps
    log = W.status_log(changes.withColumn("updated_at", F.struct("updated_at", "event_id")))
    out = W.latest_status(log)
    return out.withColumns({"updated_at": F.col("updated_at.updated_at"), "created_at": F.col("created_at.updated_at")})


@query(
    "w3_latest_status",
    with_ctes(STATUS, LATEST)
    + "SELECT task_id, stage, status, progress, error, result_ready, updated_at, created_at FROM latest",
)
def latest_status(spark, sf_dir):
    return latest(spark, sf_dir)


@query(
    "w4_open_tasks",
    with_ctes(STATUS, LATEST) + "SELECT task_id, status, progress FROM latest WHERE status NOT IN ('succeeded', 'failed')",
)
def open_tasks(spark, sf_dir):
    return W.open_tasks(latest(spark, sf_dir)).select("task_id", "status", "progress")


@query(
    "w4_task_results",
    with_ctes(STATUS, LATEST)
    + """SELECT c_custkey AS task_id, CASE WHEN l.status = 'succeeded' THEN 'ready' WHEN l.task_id IS NOT NULL THEN 'not ready'
      ELSE 'missing' END AS answer, CASE WHEN l.status = 'succeeded' THEN 'result ' || c_custkey END AS result
      FROM customer LEFT JOIN latest l ON l.task_id = c_custkey""",
)
def task_result_rows(spark, sf_dir):
    states = latest(spark, sf_dir)
    results = states.filter("status = 'succeeded'").select(
        "task_id", F.concat(F.lit("result "), F.col("task_id")).alias("result")
    )
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    return W.task_results(requests, states, results)
