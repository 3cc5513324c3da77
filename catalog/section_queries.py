"""Titles, sections and relation batches (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    KINDS,
    OUTLINE,
    SECTION_STARTS,
    outline_docs,
    sql_estimate,
    table,
    with_ctes,
)
from catalog.registry import query
from catalog.text_queries import hard_split_ctes
from relmill.config import SplitConfig
from relmill.operators import batches as B
from relmill.operators import sections as S
from relmill.operators.text import split_paragraphs

NL2 = "chr(10) || chr(10)"
MAX_TOKENS = 120


def sections(spark, sf_dir, include_parent: bool = True):
    return S.build_sections(outline_docs(spark, sf_dir), "text", include_parent, keep=("doc_id", "text"))


def flat(batches):
    """Batch rows with plain column types."""
    return batches.select(
        "doc_id",
        "batch_index",
        "split_mode",
        F.array_join("section_ids", ",").alias("section_ids"),
        "parent_title",
        "page_start",
        "page_end",
        F.size("block_ids").alias("n_blocks"),
        "estimated_tokens",
        "text",
    )


FLAT_SQL = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS batch_index,
  split_mode, section_ids, parent_title, 1 AS page_start, 1 AS page_end, 0 AS n_blocks,
  CAST({sql_estimate('text')} AS INTEGER) AS estimated_tokens, text FROM final"""

# ---- batch building blocks in SQL; every batch carries its sort key ``ord`` -----------------
CHAPTERS = (
    """chapter_keys AS (SELECT *, CASE WHEN parent_title <> '' THEN 'p:' || parent_title
      ELSE 's:' || section_id END AS ck FROM sections)""",
    """chapter_runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY section_ord) AS run FROM (
      SELECT *, CASE WHEN lag(ck) OVER (PARTITION BY doc_id ORDER BY section_ord) = ck THEN 0 ELSE 1 END AS new
      FROM chapter_keys))""",
    f"""chapters AS (SELECT doc_id, run, min(section_ord) AS first_ord, count(*) AS n_sections,
      string_agg(section_id, ',' ORDER BY section_ord) AS section_ids,
      arg_max(CASE WHEN parent_title <> '' THEN parent_title ELSE title END, section_ord) AS parent_title,
      string_agg(text, {NL2} ORDER BY section_ord) AS text FROM chapter_runs GROUP BY doc_id, run)""",
)


def _fixed(size: int, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, (section_ord - 1) // {size} AS run, min(section_ord) AS first_ord,
      count(*) AS n_sections, string_agg(section_id, ',' ORDER BY section_ord) AS section_ids,
      CASE WHEN count(DISTINCT nullif(parent_title, '')) = 1 THEN max(parent_title) ELSE '' END AS parent_title,
      string_agg(text, {NL2} ORDER BY section_ord) AS text FROM sections GROUP BY ALL)"""


# one batch per body paragraph (or per title paragraph when there is no body), led by the titles
PARAGRAPHS = (
    """placed AS (SELECT b.doc_id, b.section_ord, b.i, b.p, h.section_id, h.parent_title,
      b.p IN (h.title, h.parent_title) AS is_context FROM bodies b JOIN heads h USING (doc_id, section_ord))""",
    f"""leads AS (SELECT doc_id, section_ord, string_agg(p, {NL2} ORDER BY i) AS lead FROM (
      SELECT doc_id, section_ord, p, min(i) AS i FROM placed WHERE is_context GROUP BY ALL) GROUP BY ALL)""",
    """has_body AS (SELECT doc_id, section_ord, bool_or(NOT is_context) AS body FROM placed GROUP BY ALL)""",
    f"""by_paragraph AS (SELECT p.doc_id, p.section_ord, p.i, p.section_id AS section_ids, p.parent_title,
      CASE WHEN b.body AND l.lead IS NOT NULL THEN l.lead || {NL2} || p.p ELSE p.p END AS text
      FROM placed p JOIN has_body b USING (doc_id, section_ord) LEFT JOIN leads l USING (doc_id, section_ord)
      WHERE p.is_context <> b.body)""",
)


def _cut_levels(source: str) -> tuple[str, ...]:
    """Hard-cut pieces of the over-budget rows of ``source``, keyed by a row number."""
    over = f"over_budget AS (SELECT *, row_number() OVER () AS doc_key FROM {source} WHERE {sql_estimate('text')} > {MAX_TOKENS})"
    (hard,) = hard_split_ctes("(SELECT doc_key AS doc_id, text FROM over_budget)", "text", MAX_TOKENS)
    return over, hard


def _guarded(top: str, top_mode: str) -> tuple[str, ...]:
    """Token guard: a batch that is too long is replaced by its sections, those by their
    paragraphs, those by hard cuts. ``top`` rows have run, first_ord, n_sections."""
    to_sections = {"small_section": "false", "chapter": "true", "fixed_sections": "n_sections > 1"}[top_mode]
    fits = f"{sql_estimate('text')} <= {MAX_TOKENS}"
    return (
        f"""member AS (SELECT s.doc_id, s.section_ord, {sql_estimate('t.text')} > {MAX_TOKENS} AS top_over,
          {to_sections} AS via_section FROM sections s JOIN {top} t ON t.doc_id = s.doc_id
          AND s.section_ord >= t.first_ord AND s.section_ord < t.first_ord + t.n_sections)""",
        f"""small AS (SELECT s.doc_id, s.section_ord, s.section_id AS section_ids, s.parent_title, s.text,
          m.via_section AND {sql_estimate('s.text')} <= {MAX_TOKENS} AS stays
          FROM sections s JOIN member m USING (doc_id, section_ord) WHERE m.top_over)""",
        """deep AS (SELECT p.* FROM by_paragraph p JOIN small s USING (doc_id, section_ord) WHERE NOT s.stays)""",
        *_cut_levels("deep"),
        f"""final AS (SELECT doc_id, [first_ord, 0, 0] AS ord, '{top_mode}' AS split_mode, section_ids, parent_title, text
            FROM {top} WHERE {fits}
          UNION ALL SELECT doc_id, [section_ord, 0, 0], 'small_section', section_ids, parent_title, text FROM small WHERE stays
          UNION ALL SELECT doc_id, [section_ord, i, 0], 'paragraph', section_ids, parent_title, text FROM deep WHERE {fits}
          UNION ALL SELECT o.doc_id, [o.section_ord, o.i, h.step], 'hard_split', o.section_ids, o.parent_title, h.piece
            FROM hard h JOIN over_budget o ON o.doc_key = h.doc_id WHERE h.step > 0)""",
    )


def _plain(source: str, mode: str, ord_sql: str = "[first_ord, 0, 0]") -> str:
    return (
        f"final AS (SELECT doc_id, {ord_sql} AS ord, '{mode}' AS split_mode, section_ids, parent_title, text FROM {source})"
    )


@query(
    "b1_classify_titles",
    with_ctes(*OUTLINE, KINDS)
    + """SELECT doc_id, CAST(i AS INTEGER) AS paragraph_ord, coalesce(kind = 'N', false) AS is_numbered,
      coalesce(kind = 'C', false) AS is_chinese, coalesce(kind = 'D', false) AS is_document,
      kind IS NOT NULL AS is_title FROM kinds""",
)
def classify_titles(spark, sf_dir):
    return S.classify_titles(split_paragraphs(outline_docs(spark, sf_dir)))


SECTION_SQL = """SELECT doc_id, CAST(section_ord AS INTEGER) AS section_ord, section_id, title, parent_title,
  1 AS page_start, 1 AS page_end, text, CAST(n_paragraphs AS INTEGER) AS n_paragraphs FROM sections"""


def _flat_sections(df):
    return S.section_rows(df).select(
        "doc_id", "section_ord", "section_id", "title", "parent_title", "page_start", "page_end", "text",
        F.size("paragraphs").alias("n_paragraphs"),
    )


@query("b2_build_sections", with_ctes(*SECTION_STARTS) + SECTION_SQL)
def build_sections(spark, sf_dir):
    return _flat_sections(sections(spark, sf_dir))


@query(
    "b2_build_sections_without_parent",
    with_ctes(*[c.replace("WHERE parent_title <> ''", "WHERE false") for c in SECTION_STARTS]) + SECTION_SQL,
)
def build_sections_without_parent(spark, sf_dir):
    return _flat_sections(sections(spark, sf_dir, include_parent=False))


@query(
    "b3_batch_small_sections",
    with_ctes(*SECTION_STARTS, _fixed(1, "singles"), _plain("singles", "small_section")) + FLAT_SQL,
)
def batch_small_sections(spark, sf_dir):
    return flat(B.index_batches(B.batch_small_sections(sections(spark, sf_dir))))


@query(
    "b3_batch_fixed_sections",
    with_ctes(*SECTION_STARTS, _fixed(3, "triples"), _plain("triples", "fixed_sections")) + FLAT_SQL,
)
def batch_fixed_sections(spark, sf_dir):
    return flat(B.index_batches(B.batch_fixed_sections(sections(spark, sf_dir), 3)))


@query(
    "b4_batch_chapters",
    with_ctes(*SECTION_STARTS, *CHAPTERS, _plain("chapters", "chapter")) + FLAT_SQL,
)
def batch_chapters(spark, sf_dir):
    return flat(B.index_batches(B.batch_chapters(sections(spark, sf_dir))))


@query(
    "b5_batch_paragraphs",
    with_ctes(*SECTION_STARTS, *PARAGRAPHS, _plain("by_paragraph", "paragraph", "[section_ord, i, 0]")) + FLAT_SQL,
)
def batch_paragraphs(spark, sf_dir):
    return flat(B.index_batches(B.batch_paragraphs(sections(spark, sf_dir))))


@query(
    "b6_make_batch",
    with_ctes(*SECTION_STARTS, _fixed(1_000_000, "everything"), _plain("everything", "fixed_sections")) + FLAT_SQL,
)
def make_batch(spark, sf_dir):
    return flat(B.index_batches(B.make_batch(sections(spark, sf_dir))))


@query(
    "b7_guard_tokens",
    with_ctes(*SECTION_STARTS, *PARAGRAPHS, *CHAPTERS, *_guarded("chapters", "chapter")) + FLAT_SQL,
)
def guard_tokens(spark, sf_dir):
    chapters = B.batch_chapters(sections(spark, sf_dir))
    return flat(B.index_batches(B.guard_tokens(chapters, "chapter", MAX_TOKENS)))


@query(
    "b7_guard_tokens_fixed",
    with_ctes(*SECTION_STARTS, *PARAGRAPHS, _fixed(2, "pairs"), *_guarded("pairs", "fixed_sections")) + FLAT_SQL,
)
def guard_tokens_fixed(spark, sf_dir):
    pairs = B.batch_fixed_sections(sections(spark, sf_dir), 2)
    return flat(B.index_batches(B.guard_tokens(pairs, "fixed_sections", MAX_TOKENS)))


@query(
    "b8_index_batches",
    with_ctes(*SECTION_STARTS, _fixed(2, "pairs"), _plain("pairs", "fixed_sections"))
    + f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS batch_index,
      CAST({sql_estimate('text')} AS INTEGER) AS estimated_tokens, split_mode,
      len(string_split(section_ids, ',')) AS n_sections FROM final""",
)
def index_batches(spark, sf_dir):
    rows = B.public_batch(B.index_batches(B.batch_fixed_sections(sections(spark, sf_dir), 2)))
    return rows.select(
        "doc_id", "batch_index", "estimated_tokens", "split_mode",
        F.size("section_ids").cast("long").alias("n_sections"),
    )


@query(
    "b9_document_batch",
    with_ctes(
        "over_budget AS (SELECT doc_id AS doc_key, text FROM documents "
        f"WHERE {sql_estimate('text')} > {MAX_TOKENS})",
        *hard_split_ctes("(SELECT doc_key AS doc_id, text FROM over_budget)", "text", MAX_TOKENS),
        f"""final AS (SELECT doc_id, 0 AS ord, 'small_section' AS split_mode, 'document' AS section_ids,
            '' AS parent_title, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS text FROM documents
            WHERE {sql_estimate('text')} <= {MAX_TOKENS}
          UNION ALL SELECT doc_id, step, 'hard_split', 'document', '', piece FROM hard WHERE step > 0)""",
    )
    + FLAT_SQL,
)
def document_batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn(
        "batches", F.array().cast(f"array<{B.BATCH_TYPE}>")
    )
    return flat(B.index_batches(B.document_batch(docs, "small_section", MAX_TOKENS)))


@query(
    "b10_build_batches",
    with_ctes(*SECTION_STARTS, *PARAGRAPHS, _fixed(1, "singles"), *_guarded("singles", "small_section")) + FLAT_SQL,
)
def build_batches(spark, sf_dir):
    return flat(B.build_batches(sections(spark, sf_dir), SplitConfig(max_batch_tokens=MAX_TOKENS)))


@query(
    "b10_build_paragraph_batches",
    with_ctes(
        *SECTION_STARTS,
        *PARAGRAPHS,
        *_cut_levels("by_paragraph"),
        f"""final AS (SELECT doc_id, [section_ord, i, 0] AS ord, 'paragraph' AS split_mode, section_ids, parent_title, text
            FROM by_paragraph WHERE {sql_estimate('text')} <= {MAX_TOKENS}
          UNION ALL SELECT o.doc_id, [o.section_ord, o.i, h.step], 'hard_split', o.section_ids, o.parent_title, h.piece
            FROM hard h JOIN over_budget o ON o.doc_key = h.doc_id WHERE h.step > 0)""",
    )
    + FLAT_SQL,
)
def build_paragraph_batches(spark, sf_dir):
    config = SplitConfig(split_mode="paragraph", max_batch_tokens=MAX_TOKENS)
    return flat(B.build_batches(sections(spark, sf_dir), config))
