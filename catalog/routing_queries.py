"""Skill registry (R), routing (G), prompts (P1-P6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    RANKED,
    SELECTED,
    _lexicon_sql,
    lexicon_skills,
    q,
    scores_ctes,
    sql_strip,
    table,
    with_ctes,
)
from catalog.registry import query
from catalog.text_queries import _greedy, sql_sentences
from relmill.functions.rows import posexplode
from relmill.functions.text import doc_hash
from relmill.operators import prompts as P
from relmill.operators import routing as G
from relmill.operators import skills as R
from relmill.operators.text import chunk_by_tokens

SKILLS = lexicon_skills()
SCORES = scores_ctes("documents", "doc_id", "text")


def scored(spark, sf_dir, keep_text: bool = False):
    docs = table(spark, sf_dir, "documents")
    out = G.keyword_scores(docs, SKILLS)
    return out.select("doc_id", "text", "scores") if keep_text else out.select("doc_id", "scores")


def selected_rows(df, column: str = "selected_skills"):
    rows = df.select("doc_id", posexplode(column).alias("pos", "skill"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("rank"), "skill")


# ---- routing ------------------------------------------------------------------------------
@query(
    "g1_keyword_idf",
    """WITH kw AS (SELECT source AS skill, unnest(string_split(text, ' ')) AS keyword FROM documents),
      n AS (SELECT count(*) AS n FROM (SELECT skill FROM kw UNION SELECT n_name FROM nation))
    SELECT keyword, count(*) AS hits, round(ln(any_value(n.n) / count(*)) + 1.0, 6) AS idf
    FROM kw, n WHERE keyword <> '' GROUP BY keyword""",
)
def keyword_idf(spark, sf_dir):
    """Every word of a source is a keyword of it; nations are skills without keywords."""
    words = table(spark, sf_dir, "documents").select(F.col("source").alias("skill"), F.explode(F.split("text", " ")).alias("keyword"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    registry = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).union(names)
    return G.keyword_idf(words, registry).withColumn("idf", F.round("idf", 6))


@query("g2_keyword_scores", with_ctes(*SCORES) + "SELECT * FROM scores")
def keyword_scores(spark, sf_dir):
    return G.score_rows(scored(spark, sf_dir))


@query(
    "g3_keyword_counts",
    with_ctes(_lexicon_sql())
    + """SELECT doc_id, CAST(skill_ord AS INTEGER) AS skill_ord, skill, CAST(sum(
      (length(text) - length(replace(text, keyword, ''))) // length(keyword)) AS DOUBLE) AS score
      FROM documents, lex GROUP BY ALL""",
)
def keyword_counts(spark, sf_dir):
    return G.score_rows(G.keyword_counts(table(spark, sf_dir, "documents"), SKILLS).select("doc_id", "scores"))


@query(
    "g4_select_skills",
    with_ctes(*SCORES, RANKED, SELECTED) + "SELECT doc_id, CAST(pos AS INTEGER) AS rank, skill FROM picked",
)
def select_skills(spark, sf_dir):
    return selected_rows(G.select_skills(scored(spark, sf_dir)))


@query(
    "g5_select_skills_fallback",
    with_ctes(*SCORES, RANKED)
    + """SELECT doc_id, CAST(pos AS INTEGER) AS rank, skill FROM (SELECT *, row_number() OVER (
      PARTITION BY doc_id ORDER BY rk) AS pos FROM ranked WHERE rk = 1 OR score >= 2) WHERE pos <= 3""",
)
def select_skills_fallback(spark, sf_dir):
    return selected_rows(G.select_skills_fallback(scored(spark, sf_dir)))


NEEDS = """needs AS (SELECT doc_id, max(score) FILTER (rk = 1) AS s1, max(score) FILTER (rk = 2) AS s2
  FROM ranked GROUP BY doc_id)"""


@query(
    "g6_needs_model_route",
    with_ctes(*SCORES, RANKED, NEEDS)
    + "SELECT doc_id, s1 < 3 OR (s2 >= 1 AND s1 - s2 < 1) AS needs_model FROM needs",
)
def needs_model_route(spark, sf_dir):
    return G.needs_model_route(scored(spark, sf_dir)).select("doc_id", "needs_model")


LISTED = """string_agg(skill || '=' || format('{:g}', score), '，' ORDER BY skill_ord)"""


@query(
    "g7_route_reason",
    with_ctes(*SCORES, RANKED, SELECTED)
    + f"""SELECT doc_id, CASE WHEN max(top) < 1 THEN '规则路由：无明显关键词信号，为保证召回选择 ' ELSE '规则路由：根据关键词加权分数选择 ' END
      || any_value(names) || '。加权分数：' || {LISTED} || '。' AS router_reason FROM ranked JOIN (SELECT doc_id,
        string_agg(skill, '、' ORDER BY pos) AS names FROM picked GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""",
)
def route_reason(spark, sf_dir):
    return G.route_reason(G.select_skills(scored(spark, sf_dir))).select("doc_id", "router_reason")


# Spanish documents got no router reply; one reply in seven is unusable
REPLY_SQL = """replies AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 OR lang = 'es' THEN 'no json'
  ELSE '```json{"primary_skill":"' || ['german','bogus','web'][CAST(doc_id % 3 AS INT) + 1]
    || '","aux_skills":["french","' || lang || '","german","spanish","english"],"reason":"r'
    || doc_id || '"}```' END AS reply FROM documents)"""
MODEL_SQL = """model AS (SELECT doc_id, text, reply, CASE WHEN reply = 'no json' THEN NULL ELSE list_slice(list_filter(
    list_distinct_ordered, lambda s: s IN ('english','french','german','spanish','web')), 1, 3) END AS names
  FROM (SELECT *, list_filter([['german','bogus','web'][CAST(doc_id % 3 AS INT) + 1], 'french', 'german',
      'spanish', 'english'], lambda s, i: list_position([['german','bogus','web'][CAST(doc_id % 3 AS INT) + 1],
      'french', 'german', 'spanish', 'english'], s) = i) AS list_distinct_ordered FROM replies))"""


def router_replies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = F.get(F.array(F.lit("german"), F.lit("bogus"), F.lit("web")), (F.col("doc_id") % 3).cast("int"))
    reply = F.concat(
        F.lit('```json\nMy choice: {"primary_skill":"'), first, F.lit('","aux_skills":["french","'), F.col("lang"),
        F.lit('","german","spanish","english"],"reason":"r'), F.col("doc_id"), F.lit('"} as asked```'),
    )
    broken = F.when(F.col("lang") != "es", "no json")
    unusable = (F.col("doc_id") % 7 == 0) | (F.col("lang") == "es")
    return docs.select("doc_id", "text", F.when(unusable, broken).otherwise(reply).alias("reply"))


@query(
    "g8_resolve_model_route",
    with_ctes(REPLY_SQL, MODEL_SQL)
    + """SELECT doc_id, coalesce(array_to_string(names, ','), 'none') AS skills,
      CASE WHEN names IS NULL THEN '' ELSE 'r' || doc_id END AS reason FROM model""",
)
def resolve_model_route(spark, sf_dir):
    return G.resolve_model_route(router_replies(spark, sf_dir), SKILLS).select(
        "doc_id",
        F.coalesce(F.array_join("model_skills", ","), F.lit("none")).alias("skills"),
        F.col("model_reason").alias("reason"),
    )


def route_inputs(spark, sf_dir):
    """Scored documents, a cache of the labelled texts, replies per text hash."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_hash", doc_hash(F.col("text")))
    cached = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").withColumn(
        "route",
        F.struct(
            F.array(F.lit("web"), F.lit("gone"), F.lit("french")).alias("selected_skills"),
            F.lit(None).cast(G.SCORES_TYPE).alias("scores"),
            F.lit("stored").alias("router_reason"),
            F.lit(None).cast("string").alias("router_mode"),
        ),
    )
    cache = cached.groupBy("doc_hash").agg(F.first("route").alias("route"))
    replies = (
        router_replies(spark, sf_dir)
        .withColumn("doc_hash", doc_hash(F.col("text")))
        .groupBy("doc_hash")
        .agg(F.min_by("reply", "doc_id").alias("reply"))
    )
    scored_docs = G.keyword_scores(docs, SKILLS).select("doc_id", "doc_hash", "scores")
    return scored_docs, cache, G.resolve_model_route(replies, SKILLS)


ROUTED = (
    *SCORES,
    RANKED,
    SELECTED,
    NEEDS,
    REPLY_SQL,
    MODEL_SQL,
    "cached AS (SELECT DISTINCT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
    "modelled AS (SELECT text, arg_min(coalesce(array_to_string(names, ','), ''), doc_id) AS names FROM model GROUP BY text)",
    """routed AS (SELECT d.doc_id, d.text, c.text IS NOT NULL AS cache_hit,
      CASE WHEN c.text IS NOT NULL THEN 'web,french'
        WHEN (n.s1 < 3 OR (n.s2 >= 1 AND n.s1 - n.s2 < 1)) AND m.names <> '' THEN m.names
        ELSE r.names END AS skills,
      CASE WHEN c.text IS NOT NULL THEN 'legacy_llm_cache'
        WHEN (n.s1 < 3 OR (n.s2 >= 1 AND n.s1 - n.s2 < 1)) AND m.names <> '' THEN 'llm_router'
        ELSE 'keyword_rule' END AS router_mode
      FROM documents d JOIN needs n USING (doc_id) LEFT JOIN cached c ON c.text = d.text
      LEFT JOIN modelled m ON m.text = d.text JOIN (SELECT doc_id, string_agg(skill, ',' ORDER BY pos) AS names
        FROM picked GROUP BY doc_id) r USING (doc_id))""",
)


@query("g9_route_documents", with_ctes(*ROUTED) + "SELECT doc_id, cache_hit, skills, router_mode FROM routed")
def route_documents(spark, sf_dir):
    docs, cache, model = route_inputs(spark, sf_dir)
    return G.route_documents(docs, SKILLS, cache, model).select(
        "doc_id", "cache_hit", F.array_join("selected_skills", ",").alias("skills"), "router_mode"
    )


# ---- chunk routes ---------------------------------------------------------------------------
BUDGET = 120


def chunk_rows(spark, sf_dir):
    """Sentence chunks with the rule route of their document narrowed to one skill."""
    docs = G.select_skills(scored(spark, sf_dir, keep_text=True), 1)
    docs = docs.withColumnRenamed("selected_skills", "document_skills")
    return chunk_by_tokens(
        docs, BUDGET, keep=("doc_id", "document_skills"), sentences_only=True
    ).withColumn("document_cache_hit", F.col("doc_id") % 10 == 0)


CHUNK_SCORES = (
    f"""units AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS u, unnest(a) AS unit
      FROM (SELECT doc_id, {sql_sentences('text')} AS a FROM documents))""",
    *_greedy(BUDGET),
    f"""chunks AS (SELECT doc_id, chunk, {sql_strip("string_agg(unit, ' ' ORDER BY u)")} AS ctext,
      doc_id * 1000000 + chunk AS ck FROM packed GROUP BY doc_id, chunk)""",
    *SCORES,
    RANKED,
    "own AS (SELECT doc_id, skill AS own_skill FROM ranked WHERE rk = 1)",
    *scores_ctes("chunks", "ck", "ctext", "chunk_")[2:],
    """reroutes AS (SELECT c.doc_id, c.chunk, c.ck, o.own_skill,
      coalesce(max(s.score) FILTER (s.skill <> o.own_skill), 0) >= 2 AND
      coalesce(max(s.score) FILTER (s.skill <> o.own_skill), 0) >=
        coalesce(max(s.score) FILTER (s.skill = o.own_skill), 0) + 2 AS reroute
      FROM chunks c JOIN own o USING (doc_id) JOIN chunk_scores s ON s.ck = c.ck GROUP BY ALL)""",
)


@query(
    "g10_needs_chunk_reroute",
    with_ctes(*CHUNK_SCORES) + "SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, reroute FROM reroutes",
)
def needs_chunk_reroute(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    scored_rows = rows.withColumn("scores", G.score_array(F.col("chunk_text"), SKILLS))
    return G.needs_chunk_reroute(scored_rows, len(SKILLS)).select("doc_id", "chunk_index", "reroute")


CHUNK_ROUTES = (
    *CHUNK_SCORES,
    """chunk_ranked AS (SELECT *, row_number() OVER w AS rk, first_value(score) OVER w AS top FROM chunk_scores
      WINDOW w AS (PARTITION BY ck ORDER BY score DESC, skill_ord))""",
    """chunk_rule AS (SELECT ck, list(skill ORDER BY rk)[1:3] AS names FROM chunk_ranked
      WHERE top < 1 OR rk = 1 OR score >= 1 GROUP BY ck)""",
    """chunk_skills AS (SELECT doc_id, chunk, own_skill, reroute, CASE WHEN reroute THEN
        CASE WHEN list_contains(names, own_skill) THEN names ELSE (names || [own_skill])[1:3] END
        ELSE [own_skill] END AS names FROM reroutes JOIN chunk_rule USING (ck))""",
)


@query(
    "g11_route_chunks",
    with_ctes(*CHUNK_ROUTES)
    + """SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, array_to_string(names, ',') AS skills,
      CASE WHEN reroute THEN 'chunk_rerouted' ELSE 'document_reused' END AS routing_mode FROM chunk_skills""",
)
def route_chunks(spark, sf_dir):
    return G.route_chunks(chunk_rows(spark, sf_dir), SKILLS).select(
        "doc_id", "chunk_index", F.array_join("selected_skills", ",").alias("skills"), "routing_mode"
    )


@query(
    "g11_document_skill_total",
    with_ctes(*CHUNK_ROUTES)
    + """SELECT doc_id, string_agg(skill, ',' ORDER BY pos_at) AS skills FROM (SELECT doc_id, skill, min(pos_at) AS pos_at FROM (
        SELECT doc_id, own_skill AS skill, 0 AS pos_at FROM chunk_skills UNION ALL
        SELECT doc_id, unnest(names), 10 + chunk * 10 + generate_subscripts(names, 1) FROM chunk_skills)
      GROUP BY ALL) GROUP BY doc_id""",
)
def document_skill_total(spark, sf_dir):
    routed = G.route_chunks(chunk_rows(spark, sf_dir), SKILLS)
    return G.document_skill_total(routed).select("doc_id", F.array_join("selected_skills", ",").alias("skills"))


# ---- registry -------------------------------------------------------------------------------
def skill_candidates(spark, sf_dir):
    """One candidate skill per document, broken in a different way every few rows."""
    d = F.col("doc_id")
    item = lambda text, json: F.struct(
        text.alias("text"), json.alias("json"), F.lit(None).cast("boolean").alias("is_document_level")
    )
    one, two = '{"relation_list":[{"head":"a"}]}', '{"relation_list":[{"head":"a"},{"head":"b"}]}'
    json = (
        F.when(d % 13 == 1, " ").when(d % 13 == 2, "{bad").when(d % 13 == 3, '{"other":[]}')
        .when(d % 13 == 4, '{"relation_list":{}}').when(d % 2 == 0, one).otherwise(two)
    )
    strings = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(" s"), F.when(d % 11 == 5, " x").otherwise("-"), d).alias("name"),
        F.when(d % 17 == 3, "").otherwise(F.col("lang")).alias("description"),
        *[F.lit("v").alias(c) for c in ("focus", "head_prior", "tail_prior", "relation_style")],
        F.when(d % 19 == 4, F.lit(None)).otherwise("n").alias("negative_scope"),
        F.when(d % 23 == 5, F.lit(None).cast("array<string>")).otherwise(F.array(F.col("source"))).alias("extraction_rules"),
        F.when(d % 5 == 4, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(" k "), F.col("lang"))).alias("keywords"),
        F.when(d % 29 == 7, F.array().cast(R.FEWSHOT_TYPE))
        .when(d % 31 == 8, F.lit(None).cast(R.FEWSHOT_TYPE))
        .otherwise(F.array(item(F.lit("t"), F.lit(one)), item(F.when(d % 7 == 6, " ").otherwise("u"), json)))
        .cast(R.FEWSHOT_TYPE)
        .alias("fewshot"),
    )


@query(
    "r1_validate_skills",
    """SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN 'missing required field: description'
      WHEN doc_id % 19 = 4 THEN 'missing required field: negative_scope' WHEN doc_id % 11 = 5 THEN 'bad name'
      WHEN doc_id % 23 = 5 THEN 'field must be a list: extraction_rules'
      WHEN doc_id % 29 <> 7 AND doc_id % 31 = 8 THEN 'field must be a list: fewshot'
      WHEN doc_id % 5 = 4 THEN 'field must not be empty: keywords'
      WHEN doc_id % 29 = 7 THEN 'field must not be empty: fewshot'
      WHEN doc_id % 7 = 6 THEN 'fewshot[2].text is required' WHEN doc_id % 13 = 1 THEN 'fewshot[2].json is required'
      WHEN doc_id % 13 = 2 THEN 'fewshot[2].json must be valid JSON'
      WHEN doc_id % 13 IN (3, 4) THEN 'fewshot[2].json must contain relation_list' ELSE 'valid' END AS error,
      CASE WHEN doc_id % 11 = 5 THEN 's x' ELSE 's-' END || doc_id AS name,
      CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'k,' || lang END AS keywords FROM documents""",
)
def validate_skills(spark, sf_dir):
    return R.validate_skills(skill_candidates(spark, sf_dir)).select(
        "doc_id", F.coalesce("error", F.lit("valid")).alias("error"), "name",
        F.array_join("keywords", ",").alias("keywords"),
    )


EXAMPLES_SQL = """examples AS (SELECT doc_id, item, CASE doc_id % 4
    WHEN 0 THEN '{"relation_list":[' || item || ',' || item || ']}' WHEN 1 THEN item
    WHEN 2 THEN '[' || item || ']' ELSE 'oops' END AS json FROM (SELECT doc_id,
      '{"head":"' || lang || '","relation":"r","tail":"' || source || '"}' AS item, lang, source FROM documents))"""


@query(
    "r2_fewshot_relations",
    """SELECT doc_id, CAST(k AS INTEGER) AS relation_ord, lang AS head, 'r' AS relation, source AS tail FROM documents,
      (SELECT unnest([0, 1]) AS k) WHERE (doc_id % 4 = 0 OR k = 0) AND doc_id % 4 <> 3""",
)
def fewshot_relations(spark, sf_dir):
    item = F.concat(
        F.lit('{"head":"'), F.col("lang"), F.lit('","relation":"r","tail":"'), F.col("source"), F.lit('"}')
    )
    d = F.col("doc_id") % 4
    json = (
        F.when(d == 0, F.concat(F.lit('{"relation_list":['), item, F.lit(","), item, F.lit("]}")))
        .when(d == 1, item).when(d == 2, F.concat(F.lit("["), item, F.lit("]"))).otherwise("oops")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", json.alias("json"))
    return R.fewshot_relations(docs, keep=("doc_id",)).drop("evidence", "skill")


@query(
    "r3_registry_changes",
    """SELECT 'f' || doc_id || '.json' AS filename, CASE lang WHEN 'fr' THEN 'added'
      WHEN 'de' THEN 'removed' ELSE 'changed' END AS change FROM documents
      WHERE lang IN ('fr', 'de') OR n_chars % 3 = 0""",
)
def registry_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id"), F.lit(".json")).alias("filename"),
        F.lit(1).alias("modified"), F.col("n_chars").alias("size"), "lang",
    )
    old = docs.filter("lang != 'fr'").drop("lang")
    new = docs.filter("lang != 'de'").withColumn(
        "modified", F.when(F.col("size") % 3 == 0, 2).otherwise(1)
    ).drop("lang")
    return R.registry_changes(old, new)


# ---- prompts --------------------------------------------------------------------------------
def _examples_sql() -> str:
    rows = []
    for i, s in enumerate(SKILLS):
        for j, ex in enumerate(s.fewshot):
            rows.append(
                f"({q(s.name)}, {i}, {j}, {0 if ex.is_document_level else 1}, {q(ex.text + chr(10) + ex.json)})"
            )
    return f"examples AS (SELECT * FROM (VALUES {', '.join(rows)}) t(skill, skill_no, example_ord, level, blob))"


TERM_SQL = "'[\\x{4E00}-\\x{9FFF}]{2,}|[A-Za-z0-9_+\\-]{2,}'"


FEWSHOT_RANKS = (
    *SCORES, RANKED, SELECTED, _examples_sql(),
    """cand AS (SELECT d.doc_id, d.text, e.* FROM documents d JOIN picked p USING (doc_id)
      JOIN examples e ON e.skill = p.skill)""",
    """hits AS (SELECT c.doc_id, c.skill, c.example_ord, sum(
        (length(c.text) - length(replace(c.text, l.keyword, ''))) // length(l.keyword)
        * (1 + CASE WHEN contains(c.blob, l.keyword) THEN 3 ELSE 0 END)) AS h
      FROM cand c JOIN lex l ON l.skill = c.skill GROUP BY ALL)""",
    f"""graded AS (SELECT c.doc_id, c.skill, c.example_ord, c.level, h + len(list_intersect(
        list_distinct(regexp_extract_all(text, {TERM_SQL})), list_distinct(regexp_extract_all(blob, {TERM_SQL})))) AS score
      FROM cand c JOIN hits USING (doc_id, skill, example_ord))""",
    """placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, level, example_ord,
      skill DESC) AS rank FROM graded)""",
)


@query(
    "p1_rank_fewshot",
    with_ctes(
        *FEWSHOT_RANKS
    )
    + """SELECT doc_id, CAST(rank AS INTEGER) AS rank, skill, CAST(example_ord AS INTEGER) AS example_ord,
      CAST(score AS INTEGER) AS score FROM placed WHERE (score > 0 AND rank <= 2) OR rank = 1""",
)
def rank_fewshot(spark, sf_dir):
    return P.rank_fewshot(G.select_skills(scored(spark, sf_dir, keep_text=True)), SKILLS)


def _rules_sql() -> str:
    base = P.PromptTexts().base_rules
    rows = [f"('', -1, {i}, {q(r)})" for i, r in enumerate(base)]
    for s in SKILLS:
        own = s.extraction_rules or DEFAULT_RULES.get(s.name, ())
        rows += [f"({q(s.name)}, 0, {i}, {q(r)})" for i, r in enumerate(own)]
    return f"rules AS (SELECT * FROM (VALUES {', '.join(rows)}) t(skill, base, r_ord, rule))"


DEFAULT_RULES = {"web": ("look for links",)}
RULES_TEXT = """rules_text AS (SELECT doc_id, string_agg(n || '. ' || rule, chr(10) ORDER BY n) AS rules FROM (
  SELECT doc_id, rule, row_number() OVER (PARTITION BY doc_id ORDER BY pos, r_ord) AS n FROM (
    SELECT doc_id, 0 AS pos, r_ord, rule FROM (SELECT DISTINCT doc_id FROM picked), rules WHERE base = -1
    UNION ALL SELECT doc_id, pos, r_ord, rule FROM picked JOIN rules r ON r.skill = picked.skill AND base = 0)) GROUP BY doc_id)"""


@query(
    "p2_extraction_rules",
    with_ctes(*SCORES, RANKED, SELECTED, _rules_sql(), RULES_TEXT) + "SELECT doc_id, rules FROM rules_text",
)
def extraction_rules(spark, sf_dir):
    docs = G.select_skills(scored(spark, sf_dir))
    return P.extraction_rules(docs, SKILLS, default_rules=DEFAULT_RULES).select("doc_id", "rules")


def _skill_lines_sql() -> str:
    rows = [f"({q(s.name)}, {q(P.skill_profile(s))})" for s in SKILLS]
    shots = [
        f"({q(s.name)}, {i}, {q(s.name + (' 整篇样例 | ' if ex.is_document_level else ' 片段样例 | ') + ex.text + chr(10) + '应答 | ' + ex.json)})"
        for s in SKILLS
        for i, ex in enumerate(s.fewshot)
    ]
    return (
        f"profiles AS (SELECT * FROM (VALUES {', '.join(rows)}) t(skill, line)),\n"
        f"shots AS (SELECT * FROM (VALUES {', '.join(shots)}) t(skill, example_ord, shown))"
    )


@query(
    "p3_extraction_prompts",
    with_ctes(
        *FEWSHOT_RANKS, _rules_sql(), RULES_TEXT, _skill_lines_sql(),
        """heads AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS head, string_agg(skill, ', ' ORDER BY pos) AS names
          FROM picked JOIN profiles USING (skill) GROUP BY doc_id)""",
        """shown AS (SELECT doc_id, string_agg(shown, chr(10) ORDER BY rank) AS examples FROM placed JOIN shots USING (skill, example_ord)
          WHERE (score > 0 AND rank <= 2) OR rank = 1 GROUP BY doc_id)""",
    )
    + f"""SELECT doc_id, {q(P.PromptTexts().extraction)} || chr(10) || chr(10) || '【可选技能】' || chr(10) || head || chr(10) || chr(10)
      || '【参考样例】' || chr(10) || examples || chr(10) || chr(10) || {q(P.PromptTexts().allowed)} || names || chr(10) || rules
      || chr(10) || chr(10) || '【待处理文本】' || chr(10) || text || chr(10) AS prompt
      FROM documents JOIN heads USING (doc_id) JOIN shown USING (doc_id) JOIN rules_text USING (doc_id)""",
)
def extraction_prompts(spark, sf_dir):
    docs = G.select_skills(scored(spark, sf_dir, keep_text=True))
    return P.extraction_prompts(docs, SKILLS, "text", default_rules=DEFAULT_RULES).select("doc_id", "prompt")


@query(
    "p4_router_prompts",
    with_ctes(*SCORES, RANKED, NEEDS)
    + f"""SELECT doc_id, {q(P.PromptTexts().router)} || chr(10) || chr(10) || '【可选技能】' || chr(10)
      || string_agg('* ' || skill || ' ' || skill || ' documents | 关心 ' || skill || ' words | 得分 '
        || regexp_replace(printf('%.2f', score), '\\.?0+$', ''), chr(10) ORDER BY skill_ord)
      || chr(10) || chr(10) || {q(P.PromptTexts().router_output)} || chr(10) || chr(10) || '【待处理文本】' || chr(10)
      || any_value(text[1:3000]) || chr(10) AS prompt, any_value(length(text)) > 3000 AS text_cut
    FROM scores JOIN needs USING (doc_id) JOIN documents USING (doc_id)
    WHERE s1 < 3 OR (s2 >= 1 AND s1 - s2 < 1) GROUP BY doc_id""",
)
def router_prompts(spark, sf_dir):
    return P.router_prompts(scored(spark, sf_dir, keep_text=True), SKILLS).select("doc_id", "prompt", "text_cut")


def review_units(spark, sf_dir):
    docs = G.select_skills(scored(spark, sf_dir, keep_text=True))
    item = F.struct(
        F.concat(F.lit("h"), F.col("doc_id")).alias("head"), F.lit("r").alias("relation"),
        F.element_at("selected_skills", 1).alias("skill"),
    )
    relations = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<struct<head:string,relation:string,skill:string>>")).otherwise(F.array(item))
    chunk = lambda i: F.struct(F.lit(i).alias("chunk_index"), relations.alias("relation_list"))
    chunks = F.when(F.col("doc_id") % 3 == 0, F.array(chunk(0))).otherwise(F.array(chunk(0), chunk(1)))
    return docs.withColumns({"relations": relations, "chunk_results": chunks})


def _review(kind: str):
    def run(spark, sf_dir):
        return P.review_prompts(review_units(spark, sf_dir), kind, SKILLS).select("doc_id", "prompt")

    return run


def _review_sql(kind: str) -> str:
    """The prompt as text: what the JSON writer prints for the candidates is spelled out."""
    texts, nl = P.PromptTexts(), "chr(10)"
    lines = [f"({q(s.name)}, {q(f'* {s.name} | 关心 {s.focus} | 关系词 {s.relation_style} | 排除 {s.negative_scope}')})" for s in SKILLS]

    def item(indent: str) -> str:
        field = lambda name, value, end: f"'{indent}  \"{name}\" : \"' || {value} || '\"{end}' || {nl}"
        return (
            f"CASE WHEN doc_id % 5 = 0 THEN '[ ]' ELSE '[ {{' || {nl} || {field('head', chr(39) + 'h' + chr(39) + ' || doc_id', ',')} "
            f"|| {field('relation', chr(39) + 'r' + chr(39), ',')} || {field('skill', 'first', '')} || '{indent}}} ]' END"
        )

    if kind == "summarize":
        chunk = lambda i: f"'{{' || {nl} || '  \"chunk_index\" : {i},' || {nl} || '  \"relation_list\" : ' || {item('  ')} || {nl} || '}}'"
        candidates, usable = f"'[ ' || {chunk(0)} || ', ' || {chunk(1)} || ' ]'", "doc_id % 3 <> 0"
    else:
        candidates = f"'{{' || {nl} || '  \"relation_list\" : ' || {item('  ')} || {nl} || '}}'"
        usable = "doc_id % 5 <> 0"
    return (
        with_ctes(
            *SCORES, RANKED, SELECTED,
            f"focus AS (SELECT * FROM (VALUES {', '.join(lines)}) t(skill, line))",
            f"""about AS (SELECT doc_id, string_agg(line, {nl} ORDER BY pos) AS about, string_agg(skill, ', ' ORDER BY pos) AS names,
              arg_min(skill, pos) AS first FROM picked JOIN focus USING (skill) GROUP BY doc_id)""",
        )
        + f"""SELECT doc_id, {q(getattr(texts, kind))} || {nl} || {nl} || '【可选技能】' || {nl} || about || {nl} || {nl} || {q(texts.allowed)}
          || names || {nl} || {q(texts.shape)} || {nl} || {nl} || '【待处理文本】' || {nl} || text || {nl} || {nl} || '【已有结果】' || {nl}
          || {candidates} || {nl} AS prompt FROM documents JOIN about USING (doc_id) WHERE {usable}"""
    )


for _kind in ("proofread", "targeted", "summarize", "refine"):
    query(f"p5_review_prompts_{_kind}", _review_sql(_kind))(_review(_kind))
query(
    "p5_review_prompts_coref",
    f"SELECT doc_id, {q(P.PromptTexts().coref)} || chr(10) || chr(10) || '【待处理文本】' || chr(10) || text AS prompt FROM documents",
)(_review("coref"))


@query(
    "p6_prompt_budget",
    """SELECT event_id, task, backend, max_tokens, CAST(CASE WHEN max_tokens <= 600 THEN 0.0 ELSE 0.1 END AS DOUBLE) AS temperature FROM (
      SELECT event_id, task, backend, CAST(coalesce(CASE WHEN task = 'proofreading' THEN
        map {'local_qwen3': 1400, 'qwen_api': 2600, 'vllm': 700}[backend] WHEN task = 'targeted_proofread' THEN
        map {'local_qwen3': 1000, 'qwen_api': 1800, 'vllm': 600}[backend] ELSE
        map {'local_qwen3': 800, 'qwen_api': 2200, 'vllm': 900}[backend] END,
        CASE task WHEN 'proofreading' THEN 3600 WHEN 'targeted_proofread' THEN 2400 ELSE 4200 END) AS INTEGER) AS max_tokens
      FROM (SELECT event_id, ['extraction', 'proofreading', 'targeted_proofread', 'other'][event_id % 4 + 1] AS task,
        ['vllm', 'qwen_api', 'local_qwen3', 'openai', 'api'][event_id % 5 + 1] AS backend FROM events))""",
)
def prompt_budget(spark, sf_dir):
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % n).cast("int"))
    events = table(spark, sf_dir, "events").select(
        "event_id",
        pick(("extraction", "proofreading", "targeted_proofread", "other"), 4).alias("task"),
        pick(("vllm", "qwen_api", "local_qwen3", "openai", "api"), 5).alias("backend"),
    )
    return P.prompt_budget(events)
