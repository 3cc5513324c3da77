"""Inputs that the queries derive from the driver tables, in Spark and as SQL.

All document-shaped inputs are built inside the document row (no grouping): lines become
paragraphs, pages or layout blocks, sentences become relations. The SQL twin of each is a
list of CTEs that the oracle strings are assembled from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.functions.text import WS, WS_CHARS, let, non_empty, strip
from relmill.operators.skills import Example, Skill
from relmill.plans.store import work_dir  # noqa: F401


# ---- plumbing ---------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {q(WS_CHARS)})"


def sql_edges(x: str) -> str:
    return f"trim({x}, ' ，。；：,.;')"


def sql_compact(x: str) -> str:
    return f"regexp_replace({x}, {q(WS + '+')}, '', 'g')"


def sql_tokens(x: str) -> str:
    return (
        f"(len(regexp_extract_all({x}, '[\\x{{4E00}}-\\x{{9FFF}}]')) + len(regexp_extract_all({x}, "
        f"'[A-Za-z0-9_+\\-]+')) + greatest(1, len(regexp_extract_all({x}, "
        + q("[，。！？；：,.!?;:（）()【】\\[\\]“”\"'、\\-]")
        + ")) // 4))"
    )


def sql_estimate(x: str) -> str:
    return f"((length({sql_strip(x)}) + 1) // 2)"


def with_ctes(*parts: str) -> str:
    """WITH clause; tables that do not refer to themselves are computed once."""

    def pinned(part: str) -> str:
        name = part.split(" AS (", 1)[0]
        recursive = f" {name} " in part.split(" AS (", 1)[1]
        return part if recursive else part.replace(" AS (", " AS MATERIALIZED (", 1)

    return "WITH RECURSIVE " + ",\n".join(map(pinned, parts)) + "\n"


# ---- lines ------------------------------------------------------------------------------
def line_array(text: Column) -> Column:
    return non_empty(F.transform(F.split(text, "\n"), strip))


LINES = f"""lines AS (
  SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
      lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM documents))"""


# ---- outline documents ------------------------------------------------------------------
def outline_docs(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Documents with chapter, numbered and document titles put before some of their lines.

    Every line stays whole; a title is made from the beginning of the line it precedes.
    ``dealt``: the documents are partitioned by ``doc_id``.
    """

    def titled(p: Column, i: Column) -> Column:
        title = (
            F.when(i % 9 == 0, F.concat(F.lit("一、"), F.substring(p, 1, 20)))
            .when((i % 9).isin(1, 4), F.concat(F.lit("1."), i.cast("string"), F.lit(" "), F.substring(p, 1, 15)))
            .when(i % 9 == 6, F.concat(F.lit("《"), F.substring(p, 1, 10), F.lit("》")))
            .when(i % 9 == 7, F.concat(F.lit("二、"), F.substring(p, 1, 12)))
        )
        return F.array_compact(F.array(title, p))

    docs = table(spark, sf_dir, "documents")
    if dealt:
        docs = docs.repartition("doc_id")
    text = F.array_join(F.flatten(F.transform(line_array(F.col("text")), titled)), "\n\n")
    return docs.select("doc_id", text.alias("text"))


OUTLINE = (
    LINES,
    f"""titled AS (SELECT doc_id, 2 * i AS k, {sql_strip('t')} AS p FROM (
  SELECT doc_id, i, CASE i % 9 WHEN 0 THEN '一、' || substr(p, 1, 20)
    WHEN 1 THEN '1.' || i || ' ' || substr(p, 1, 15) WHEN 4 THEN '1.' || i || ' ' || substr(p, 1, 15)
    WHEN 6 THEN '《' || substr(p, 1, 10) || '》' WHEN 7 THEN '二、' || substr(p, 1, 12) END AS t FROM lines)
    WHERE t IS NOT NULL)""",
    """paras AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM (
    FROM titled UNION ALL SELECT doc_id, 2 * i + 1, p FROM lines))""",
)
KINDS = f"""kinds AS (SELECT *, CASE
    WHEN regexp_matches(p, '^\\p{{Nd}}+([.．]\\p{{Nd}}+)+{WS}*[^\\n]*$') THEN 'N'
    WHEN regexp_matches(p, '^[一二三四五六七八九十百千万]+、') THEN 'C'
    WHEN p LIKE '《%' AND p LIKE '%》%' AND length(p) <= 80 THEN 'D' END AS kind FROM paras)"""
SECTION_STARTS = (
    *OUTLINE,
    KINDS,
    """flags AS (SELECT *, coalesce(kind = 'C' AND lead(kind) OVER w = 'N', false) AS parent
    FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY i))""",
    """marks AS (SELECT *, kind IS NOT NULL OR i = 0 AS boundary,
      last_value(CASE WHEN kind <> 'N' THEN CASE WHEN parent THEN p ELSE '' END END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt,
      sum(CASE WHEN (kind IS NOT NULL OR i = 0) AND NOT parent THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i) AS section_ord FROM flags)""",
    """heads AS (SELECT doc_id, section_ord,
      CASE WHEN kind IS NULL THEN '' ELSE p END AS title,
      CASE WHEN kind = 'N' THEN coalesce(pt, '') ELSE '' END AS parent_title,
      CASE kind WHEN 'N' THEN replace(regexp_extract(p, '^(\\p{Nd}+([.．]\\p{Nd}+)+)', 1), '．', '.')
        WHEN 'C' THEN regexp_extract(p, '^([一二三四五六七八九十百千万]+)、', 1)
        WHEN 'D' THEN 'doc-title' ELSE 'section-' || lpad(section_ord::VARCHAR, 3, '0') END AS section_id
    FROM marks WHERE boundary AND NOT parent)""",
    """bodies AS (SELECT doc_id, section_ord, i, p FROM marks WHERE NOT parent
    UNION ALL SELECT doc_id, section_ord, -1, parent_title FROM heads WHERE parent_title <> '')""",
    """sections AS (SELECT h.*, string_agg(b.p, chr(10) || chr(10) ORDER BY b.i) AS text,
      count(*) AS n_paragraphs FROM heads h JOIN bodies b USING (doc_id, section_ord) GROUP BY ALL)""",
)


# ---- lexicon ------------------------------------------------------------------------------
LEXICON = {
    "english": ("the", "and", "tion", "that"),
    "french": ("eaux", "elle", "ment", "que"),
    "german": ("sch", "und", "nicht"),
    "spanish": ("que", "los", "para", "para"),
    "web": ("http", "@"),
}


def lexicon_skills() -> list[Skill]:
    """Registry over :data:`LEXICON` with small examples and rules."""

    def examples(name: str, words: tuple[str, ...]) -> tuple[Example, ...]:
        one = f'{{"relation_list":[{{"head":"{words[0]}","relation":"r","tail":"t"}}]}}'
        two = one.replace("]}", f',{{"head":"{name}","relation":"r","tail":"u"}}]}}')
        return (
            Example(f"{words[0]} and {name} text", one, False),
            Example(f"of {words[-1]} the {name} in", two, True),
        )

    return [
        Skill(
            name=name,
            keywords=words,
            description=f"{name} documents",
            focus=f"{name} words",
            head_prior="entity",
            tail_prior="entity",
            relation_style="short",
            negative_scope="none",
            fewshot=examples(name, words),
            extraction_rules=() if name == "web" else (f"read {name}", f"keep {name} names"),
        )
        for name, words in LEXICON.items()
    ]


def _lexicon_sql() -> str:
    rows = [
        f"({i}, {q(name)}, {j}, {q(word)})"
        for i, (name, words) in enumerate(LEXICON.items())
        for j, word in enumerate(words)
    ]
    return f"lex AS (SELECT * FROM (VALUES {', '.join(rows)}) t(skill_ord, skill, k_ord, keyword))"


def scores_ctes(texts: str, key: str, text: str, prefix: str = "") -> tuple[str, ...]:
    """Score rows ``{prefix}scores(key, skill_ord, skill, score)`` over a text relation."""
    return (
        _lexicon_sql(),
        """idf AS (SELECT keyword, ln(5.0 / count(*)) + 1.0 AS idf FROM lex GROUP BY keyword)""",
        f"""{prefix}scores AS (SELECT {key}, skill_ord, skill, round(sum(
      ((length({text}) - length(replace({text}, keyword, ''))) // length(keyword)) * idf
        * CASE WHEN length(keyword) >= 4 THEN 1.5 ELSE 1.0 END), 2) AS score
    FROM {texts}, lex JOIN idf USING (keyword) GROUP BY ALL)""",
    )


RANKED = """ranked AS (SELECT *, row_number() OVER w AS rk, first_value(score) OVER w AS top
    FROM scores WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, skill_ord))"""
SELECTED = """picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS pos
    FROM ranked WHERE top < 1 OR rk = 1 OR score >= 1) WHERE pos <= 3)"""


# ---- relations ----------------------------------------------------------------------------
def relation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a relation array built from their sentences.

    Some heads, predicates, tails and evidences are replaced by position so that every
    cleaning rule has something to do.
    """

    def build(s: Column, i: Column) -> Column:
        def of_words(w: Column) -> Column:
            first, second, last = F.get(w, F.lit(0)), F.lower(F.get(w, F.lit(1))), F.element_at(w, -1)
            head = (
                F.when(i % 17 == 0, "我方")
                .when(i % 17 == 5, "主要目标")
                .when(i % 17 == 9, F.concat(first, first))
                .otherwise(first)
            )
            fixed = ("部署", "负责", "任务", "必须", "位于", "实施", "受控制", "涉及")
            relation = F.coalesce(F.get(F.array(*map(F.lit, fixed)), (i % 13)), second)
            tail = (
                F.when(i % 11 == 0, F.concat(last, F.lit("区")))
                .when(i % 11 == 1, F.concat(F.lit("到达前，"), last))
                .when(i % 11 == 2, F.array_join(F.slice(w, 1, 3), "、"))
                .when(i % 11 == 3, F.concat(F.lit("压制"), last))
                .when(i % 11 == 4, F.concat(first, F.lit("和"), last))
                .when(i % 11 == 6, F.concat(s, F.lit("；"), last))
                .otherwise(last)
            )
            evidence = (
                F.when(i % 7 == 0, "").when(i % 7 == 3, F.concat(F.lit("x"), s)).otherwise(s)
            )
            return F.struct(
                head.alias("head"),
                relation.alias("relation"),
                tail.alias("tail"),
                evidence.alias("evidence"),
                F.when(i % 19 == 0, "unknown").otherwise(F.col("lang")).alias("skill"),
            )

        return let(F.split(s, " +"), of_words)

    docs = table(spark, sf_dir, "documents")
    pieces = non_empty(F.transform(F.split("text", "[.\n]+"), strip))
    sentences = F.filter(pieces, lambda s: F.size(F.split(s, " +")) >= 3)
    return docs.select(
        "doc_id", "text", "lang", let(sentences, lambda ss: F.transform(ss, build)).alias("relations")
    )


RELATIONS = f"""sent AS (
  SELECT doc_id, lang, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS o FROM (
    SELECT doc_id, lang, list_filter(list_transform(string_split_regex(text, '[.\\n]+'),
      lambda x: {sql_strip('x')}), lambda x: x <> '' AND len(string_split_regex(x, ' +')) >= 3) AS ss
    FROM documents)),
words AS (SELECT *, string_split_regex(s, ' +') AS w FROM sent),
rel AS (SELECT doc_id, o AS relation_ord,
  CASE o % 17 WHEN 0 THEN '我方' WHEN 5 THEN '主要目标' WHEN 9 THEN w[1] || w[1] ELSE w[1] END AS head,
  CASE o % 13 WHEN 0 THEN '部署' WHEN 1 THEN '负责' WHEN 2 THEN '任务' WHEN 3 THEN '必须' WHEN 4 THEN '位于'
    WHEN 5 THEN '实施' WHEN 6 THEN '受控制' WHEN 7 THEN '涉及' ELSE lower(w[2]) END AS relation,
  CASE o % 11 WHEN 0 THEN w[-1] || '区' WHEN 1 THEN '到达前，' || w[-1]
    WHEN 2 THEN array_to_string(w[1:3], '、') WHEN 3 THEN '压制' || w[-1]
    WHEN 4 THEN w[1] || '和' || w[-1] WHEN 6 THEN s || '；' || w[-1] ELSE w[-1] END AS tail,
  CASE o % 7 WHEN 0 THEN '' WHEN 3 THEN 'x' || s ELSE s END AS evidence,
  CASE WHEN o % 19 = 0 THEN 'unknown' ELSE lang END AS skill FROM words)"""


# ---- layout blocks and pages ----------------------------------------------------------------
def block_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout results: one block per line with mixed labels, groups, pages and ids."""

    def block(p: Column, i: Column) -> Column:
        labels = F.array(*map(F.lit, ("doc_title", "text", "number", "text", "aside_text", "text")))
        null_int = F.lit(None).cast("int")
        return F.struct(
            F.get(labels, i % 6).alias("block_label"),
            F.when(i % 7 == 6, F.lit(" ")).otherwise(p).alias("block_content"),
            F.array(i.cast("double"), F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("block_bbox"),
            i.alias("block_id"),
            F.when(i % 9 == 8, null_int).when(i % 8 == 7, i - 1).otherwise(i).alias("global_block_id"),
            F.when(i % 5 == 3, null_int).otherwise(i % 4).alias("group_id"),
            (i % 2).alias("global_group_id"),
            F.when(i % 10 == 7, F.floor(i / 5).cast("int") + 1).alias("page"),
        )

    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 4 + 1).cast("int")).alias("page_count"),
        F.transform(line_array(F.col("text")), block).alias("parsing_res_list"),
    )


BLOCKS = (
    LINES,
    """blocks AS (SELECT doc_id, i, ['doc_title','text','number','text','aside_text','text'][i % 6 + 1] AS label,
    CASE WHEN i % 7 = 6 THEN ' ' ELSE p END AS content, i % 2 AS global_group_id,
    CASE WHEN i % 9 = 8 THEN NULL WHEN i % 8 = 7 THEN i - 1 ELSE i END AS gid,
    CASE WHEN i % 5 = 3 THEN NULL ELSE i % 4 END AS group_id,
    CASE WHEN i % 10 = 7 THEN i // 5 + 1 END AS explicit FROM lines)""",
    """eligible AS (SELECT doc_id, i, coalesce(group_id, 0) AS g FROM blocks
    WHERE explicit IS NULL AND label NOT IN ('aside_text', 'seal'))""",
    """breaks AS (SELECT doc_id, i FROM (SELECT *, lag(g) OVER (PARTITION BY doc_id ORDER BY i) AS pg
    FROM eligible) WHERE g = 0 AND pg >= 0)""",
    """numbered AS (SELECT b.*, coalesce(gid, i) AS block_key, coalesce(explicit, 1 +
      sum(CASE WHEN x.brk THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY b.i)) AS own_page
    FROM blocks b LEFT JOIN (SELECT doc_id, i, true AS brk FROM breaks) x USING (doc_id, i))""",
    """paged AS (SELECT *, last_value(own_page) OVER (PARTITION BY doc_id, block_key ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page FROM numbered)""",
    f"""texts AS (SELECT *, {sql_strip('content')} AS body FROM paged
    WHERE {sql_strip('content')} <> '' AND label NOT IN ('number','footnote','header','header_image',
      'footer','footer_image','aside_text','seal'))""",
)


def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page arrays: every line is a page, every seventh one blank."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.transform(
            line_array(F.col("text")),
            lambda p, i: F.struct(
                (i + 1).alias("page_index"), F.when(i % 7 == 6, F.lit(" \n")).otherwise(p).alias("text")
            ),
        ).alias("pages"),
    )


PAGES = (
    LINES,
    "pages_in AS (SELECT doc_id, i + 1 AS page_index, p AS text FROM lines WHERE i % 7 <> 6)",
)


# ---- status log ---------------------------------------------------------------------------
def stage_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {
        "view": "layout_parsing",
        "click": "restructure_pages",
        "signup": "relation_extraction",
        "purchase": "completed",
        "error": "failed",
    }
    pairs = F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        F.try_element_at(pairs, F.col("event_type")).alias("stage"),
        F.col("ts").alias("updated_at"),
        F.concat(F.lit("event "), F.col("event_id")).alias("error"),
        "event_id",
    )


STATUS = """log AS (SELECT user_id AS task_id, event_id, ts AS updated_at,
  CASE event_type WHEN 'view' THEN 'layout_parsing' WHEN 'click' THEN 'restructure_pages'
    WHEN 'signup' THEN 'relation_extraction' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS stage,
  CASE event_type WHEN 'view' THEN 'ocr_running' WHEN 'click' THEN 'ocr_running'
    WHEN 'signup' THEN 'extracting' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status,
  CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 30 WHEN 'signup' THEN 55 ELSE 100 END AS progress,
  CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS error,
  event_type = 'purchase' AS result_ready FROM events)"""
