"""Text cleaning, splitting and chunking (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    PAGES,
    page_docs,
    q,
    sql_edges,
    sql_strip,
    sql_tokens,
    table,
    with_ctes,
)
from catalog.registry import query
from relmill.functions.text import WS
from relmill.operators import text as T

BREAK = "\x02"  # in no given text


def _pieces(array: str, value: str, ord_name: str, source: str = "documents") -> str:
    """Rows of a list expression with its 0-based position."""
    return (
        f"SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS {ord_name}, "
        f"unnest(a) AS {value} FROM (SELECT doc_id, {array} AS a FROM {source})"
    )


def _stripped(split: str) -> str:
    return f"list_filter(list_transform({split}, lambda x: {sql_strip('x')}), lambda x: x <> '')"


def sql_sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([。！？!?])', '\\1' || chr(10), 'g')"
    marked = f"regexp_replace({marked}, '\\.{WS}+', '.' || chr(10), 'g')"
    pieces = _stripped(f"string_split_regex({marked}, '\\n+')")
    return f"CASE WHEN len({pieces}) > 0 THEN {pieces} ELSE [{x}] END"


def marked_docs(spark, sf_dir):
    """Documents with outline markers and image markup worked into their lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat(
            F.regexp_replace("text", "\n", "。\n 1. "),
            F.lit("；（二） "),
            F.col("lang"),
            F.lit("\r\n第3阶段 "),
            F.col("source"),
            F.lit(" 二、a\uffff b"),
        ).alias("text"),
    )


MARKED = """marked AS (SELECT doc_id, replace(text, chr(10), '。' || chr(10) || ' 1. ') || '；（二） ' || lang
  || chr(13) || chr(10) || '第3阶段 ' || source || ' 二、a\uffff b' AS text FROM documents)"""
# pieces end behind a boundary character; one opens a section when it starts with a marker
OUTLINE_PIECES = (
    MARKED,
    f"""unified AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM marked)""",
    f"""bits AS (SELECT doc_id, unnest(a) AS bit, generate_subscripts(a, 1) AS b FROM (SELECT doc_id,
      string_split(regexp_replace(text, '([\\n。！？!?；;])', '\\1{BREAK}', 'g'), '{BREAK}') AS a FROM unified))""",
    # blanks between a boundary and the marker may themselves contain boundaries
    f"""opened AS (SELECT *, b > 1 AND regexp_matches(bit, '^{WS}*(第[一二三四五六七八九十百千万\\p{{Nd}}]+阶段'
      || '|[（(][一二三四五六七八九十百千万\\p{{Nd}}]+[）)]|\\p{{Nd}}+[.．、]({WS}|[一-龥A-Za-z])'
      || '|[一二三四五六七八九十]+[、.．])') AS opens FROM bits)""",
    """grouped AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b) AS g
      FROM opened)""",
    f"""outline AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS piece_ord, piece
      FROM (SELECT doc_id, g, {sql_strip("string_agg(bit, '' ORDER BY b)")} AS piece FROM grouped
        GROUP BY doc_id, g) WHERE piece <> '')""",
)


def _units(budget: int) -> str:
    return f"""units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece_ord, k) - 1 AS u, unit
      FROM (SELECT doc_id, piece_ord, unnest(a) AS unit, generate_subscripts(a, 1) AS k FROM (
        SELECT doc_id, piece_ord, CASE WHEN {sql_tokens('piece')} <= {budget} THEN [piece]
          ELSE {sql_sentences('piece')} END AS a FROM outline)))"""


def _greedy(budget: int) -> tuple[str, str]:
    """Fold over the units of every document, one unit per recursion step."""
    return (
        f"sized AS (SELECT *, {sql_tokens('unit')} AS n FROM units)",
        f"""packed AS (SELECT doc_id, u, unit, n AS total, 0 AS chunk FROM sized WHERE u = 0
          UNION ALL SELECT s.doc_id, s.u, s.unit,
            CASE WHEN p.total + s.n > {budget} THEN s.n ELSE p.total + s.n END,
            CASE WHEN p.total + s.n > {budget} THEN p.chunk + 1 ELSE p.chunk END
          FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.u = p.u + 1)""",
    )


CHUNKS = f"""SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index,
  {sql_strip("string_agg(unit, ' ' ORDER BY u)")} AS chunk_text FROM packed GROUP BY doc_id, chunk"""


def sql_clean_images(x: str) -> str:
    # fixed values: the image patterns, in the dialect of the twin
    steps = (
        ("(?is)<img\\b[^>]*>", "''"),
        ("!\\[[^\\]\\n]*\\]\\(\\s*(<[^>\\n]*>|[^)\\n]*)\\s*\\)", "''"),
        ("!\\[[^\\]\\n]*\\]\\[[^\\]\\n]*\\]", "''"),
        (
            "(?im)^[ \\t]*\\[[^\\]\\n]+\\]:[ \\t]*(data:image/[^ \\t\\n]+|(\\.{0,2}/)?(images?|figures?|assets?)/\\S+|attachment:\\S+).*$",
            "''",
        ),
        ("data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=\\r\\n]+", "''"),
        ("[ \\t]+\\n", "chr(10)"),
        ("[ \\t]{2,}", "' '"),
        ("\\n{3,}", "chr(10) || chr(10)"),
    )
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, {q(pattern)}, {replacement}, 'g')"
    return sql_strip(x)


@query(
    "t1_strip_image_markup",
    f"""SELECT page_id, {sql_clean_images('t')} AS text
    FROM (SELECT page_id, html || chr(10) || chr(10) || '![x](' || url || ')' || chr(10) || chr(10)
      || '<IMG src="' || url || '"' || chr(10) || '>  end' || chr(10) || '![a][b]  ' || chr(10)
      || '[b]: ./images/' || page_id || '.png "t"' || chr(10) || 'data:image/png;base64,AA+/=' || chr(10)
      || ' tail' AS t FROM pages)""",
)
def strip_image_markup(spark, sf_dir):
    url, nl = F.col("url"), F.lit("\n")
    dirty = F.concat(
        F.col("html"), nl, nl, F.lit("![x]("), url, F.lit(")\n\n<IMG src=\""), url, F.lit("\"\n>  end\n"),
        F.lit("![a][b]  \n[b]: ./images/"), F.col("page_id"), F.lit(".png \"t\"\n"),
        F.lit("data:image/png;base64,AA+/=\n tail"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", dirty.alias("text"))
    return T.strip_image_markup(pages)


@query(
    "t2_split_paragraphs",
    _pieces(
        _stripped(
            f"string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\\n{WS}*\\n+')"
        ),
        "content",
        "paragraph_ord",
    ),
)
def split_paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return T.split_paragraphs(docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n"))))


@query("t3_split_sentences", _pieces(sql_sentences("text"), "sentence", "sentence_ord"))
def split_sentences(spark, sf_dir):
    return T.split_sentences(table(spark, sf_dir, "documents"))


@query(
    "t4_sentence_segments",
    _pieces(
        "("
        + _stripped(
            f"string_split(regexp_replace(text, '([。！？.!?]){WS}+', '\\1{BREAK}', 'g'), '{BREAK}')"
        )
        + ")[1:5]",
        "segment",
        "segment_ord",
    ),
)
def sentence_segments(spark, sf_dir):
    return T.sentence_segments(table(spark, sf_dir, "documents"), 5)


@query(
    "t5_evidence_units",
    _pieces(
        "list_filter(list_transform(string_split_regex(text, '[。！？!?；;\\n]+'), "
        f"lambda x: {sql_edges('x')}), lambda x: x <> '')",
        "unit",
        "unit_ord",
    ),
)
def evidence_units(spark, sf_dir):
    return T.evidence_units(table(spark, sf_dir, "documents"))


@query(
    "t6_split_outline",
    with_ctes(*OUTLINE_PIECES)
    + "SELECT doc_id, CAST(piece_ord AS INTEGER) AS piece_ord, piece FROM outline",
)
def split_outline(spark, sf_dir):
    return T.split_outline(marked_docs(spark, sf_dir))


@query(
    "t7_outline_units",
    with_ctes(*OUTLINE_PIECES, _units(60))
    + "SELECT doc_id, CAST(u AS INTEGER) AS unit_ord, unit FROM units",
)
def outline_units(spark, sf_dir):
    return T.outline_units(marked_docs(spark, sf_dir), 60)


@query("t8_chunk_by_tokens", with_ctes(*OUTLINE_PIECES, _units(60), *_greedy(60)) + CHUNKS)
def chunk_by_tokens(spark, sf_dir):
    return T.chunk_by_tokens(marked_docs(spark, sf_dir), 60)


SENTENCE_UNITS = f"""units AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS u, unnest(a) AS unit
  FROM (SELECT doc_id, {sql_sentences('text')} AS a FROM documents))"""


@query("t8_chunk_sentences_by_tokens", with_ctes(SENTENCE_UNITS, *_greedy(120)) + CHUNKS)
def chunk_sentences_by_tokens(spark, sf_dir):
    return T.chunk_by_tokens(table(spark, sf_dir, "documents"), 120, sentences_only=True)


def _cut_ctes(source: str, key: str, limit: int) -> tuple[str, ...]:
    """Paragraph packing with exact cuts as a recursion: (rest, piece) per step.

    ``rest`` is the paragraph-joined text; a step takes the longest run of whole
    paragraphs that fits, else exactly ``limit`` characters.
    """
    joined = (
        f"array_to_string({_stripped(f'''string_split_regex({source}, chr(10) || '{{2,}}')''')}, chr(10) || chr(10))"
    )
    fits = (
        f"(SELECT max(e) FROM (SELECT unnest(list_filter(list_transform(range(1, least(length(rest), {limit}) + 1),"
        f" lambda e: CASE WHEN e = length(rest) OR rest[e + 1:e + 2] = chr(10) || chr(10) THEN e END),"
        f" lambda e: e IS NOT NULL)) AS e))"
    )
    return (
        f"joined AS (SELECT *, {joined} AS rest0 FROM {key})",
        f"""cuts AS (SELECT doc_id, item, 0 AS step, '' AS piece, rest0 AS rest FROM joined WHERE rest0 <> ''
          UNION ALL SELECT doc_id, item, step + 1, {sql_strip('rest[1:n]')},
            {sql_strip('rest[n + 1:]')} FROM (SELECT *, coalesce({fits}, {limit}) AS n FROM cuts WHERE rest <> ''))""",
    )


@query(
    "t10_split_long_text",
    with_ctes(
        "src AS (SELECT doc_id, 0 AS item, replace(text, '. ', '.' || repeat(chr(10), 3)) AS t FROM documents)",
        *_cut_ctes("t", "src", 120),
    )
    + "SELECT doc_id, CAST(step - 1 AS INTEGER) AS piece_ord, piece FROM cuts WHERE step > 0",
)
def split_long_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return T.split_long_text(docs.withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n\n"))), 120)


PAGE_LIMIT = 400


@query(
    "t9_chunk_by_chars",
    with_ctes(
        *PAGES,
        "src AS (SELECT doc_id, page_index AS item, text AS t FROM pages_in)",
        *_cut_ctes("t", f"(SELECT * FROM src WHERE length(t) > {PAGE_LIMIT})", PAGE_LIMIT),
        f"""items AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, step) - 1 AS k FROM (
          SELECT doc_id, item AS page, 0 AS step, t, false AS solo FROM src WHERE length(t) <= {PAGE_LIMIT}
          UNION ALL SELECT doc_id, item, step, piece, true FROM cuts WHERE step > 0))""",
        f"""packed AS (SELECT doc_id, k, page, t, solo, length(t) AS total, 0 AS chunk FROM items WHERE k = 0
          UNION ALL SELECT s.doc_id, s.k, s.page, s.t, s.solo,
            CASE WHEN s.solo OR p.solo OR p.total + 2 + length(s.t) > {PAGE_LIMIT} THEN length(s.t)
              ELSE p.total + 2 + length(s.t) END,
            CASE WHEN s.solo OR p.solo OR p.total + 2 + length(s.t) > {PAGE_LIMIT} THEN p.chunk + 1
              ELSE p.chunk END
          FROM packed p JOIN items s ON s.doc_id = p.doc_id AND s.k = p.k + 1)""",
    )
    + """SELECT doc_id, 'chunk-' || (chunk + 1) AS chunk_id, string_agg(t, chr(10) || chr(10) ORDER BY k) AS text,
      CAST(min(page) AS INTEGER) AS page_start, CAST(max(page) AS INTEGER) AS page_end
      FROM packed GROUP BY doc_id, chunk""",
)
def chunk_by_chars(spark, sf_dir):
    return T.chunk_by_chars(page_docs(spark, sf_dir), PAGE_LIMIT)


def hard_split_ctes(source: str, text: str, max_tokens: int) -> tuple[str, ...]:
    """Hard cuts as a recursion over the remaining text of ``source(key, text)``."""
    window, floor = max_tokens * 2, max_tokens
    options = []
    for sep in ("chr(10) || chr(10)", "chr(10)", "'。'", "'；'", "'，'", "' '"):
        # position of the last separator: cut off the part behind it and measure the rest
        last = (
            f"(CASE WHEN contains(win, {sep}) THEN length(win) - length(string_split(win, {sep})[-1]) END)"
        )
        options.append(f"CASE WHEN {last} - length({sep}) >= {floor} THEN {last} END")
    cut = f"coalesce({', '.join(options)}, {window})"
    return (
        f"""hard AS (SELECT doc_id, 0 AS step, '' AS piece, {sql_strip(text)} AS rest FROM {source}
          UNION ALL SELECT doc_id, step + 1, {sql_strip('rest[1:n]')}, {sql_strip('rest[n + 1:]')} FROM (
            SELECT *, CASE WHEN length(rest) <= {window} THEN length(rest) ELSE {cut} END AS n FROM (
              SELECT *, rest[1:{window}] AS win FROM hard WHERE rest <> '')))""",
    )


@query(
    "t11_hard_split",
    with_ctes(*hard_split_ctes("documents", "replace(text, ', ', '，')", 100))
    + "SELECT doc_id, CAST(step - 1 AS INTEGER) AS piece_ord, piece FROM hard WHERE step > 0",
)
def hard_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return T.hard_split(docs.withColumn("text", F.replace("text", F.lit(", "), F.lit("，"))), 100)


@query(
    "t12_corpus_profile",
    with_ctes(*OUTLINE_PIECES, _units(60), *_greedy(60))
    + f"""SELECT m.doc_id, CAST({sql_tokens('m.text')} AS INTEGER) AS doc_token_count,
      {sql_tokens('m.text')} > 200 AS used_chunking,
      CAST(CASE WHEN {sql_tokens('m.text')} > 200 THEN n ELSE 1 END AS INTEGER) AS chunk_count
      FROM marked m LEFT JOIN (SELECT doc_id, max(chunk) + 1 AS n FROM packed GROUP BY doc_id) USING (doc_id)""",
)
def corpus_profile(spark, sf_dir):
    return T.corpus_profile(marked_docs(spark, sf_dir), 200, 60)
