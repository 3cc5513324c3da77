"""Reply parsing (P7-P9), coreference (C) and relation cleaning and merging (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    RELATIONS,
    q,
    relation_docs,
    sql_compact,
    sql_edges,
    sql_strip,
    sql_tokens,
    table,
    with_ctes,
)
from catalog.registry import query
from relmill.functions.rows import posexplode
from relmill.operators import coref as C
from relmill.operators import fuzzy as Z
from relmill.operators import relations as M
from relmill.operators import responses as P
from relmill.operators import review as V

LANGS = ("en", "fr", "de")
FIELDS = list(M.FIELDS)


def relation_rows(spark, sf_dir, witness: bool = False):
    docs = relation_docs(spark, sf_dir)
    if not witness:
        return M.explode_relations(docs)
    return M.explode_relations(M.with_witness(docs), keep=("doc_id", *M.WITNESS))


# ---- cleaning in SQL ------------------------------------------------------------------------
ORD = "CAST(relation_ord AS INTEGER) AS relation_ord"
DOUBLETS = "('人人','看看','想想','谢谢','往往','常常','刚刚','仅仅','稍稍')"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _has_any(x: str, literals) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(v)})" for v in literals) + ")"


def _repair(x: str) -> str:
    """First doubled run of 2-5 characters removed, else null."""
    options = []
    for n in (2, 3, 4, 5):
        spared = f" AND substr({x}, i, {n}) NOT IN {DOUBLETS}" if n == 2 else ""
        at = (
            f"list_filter(range(1, length({x}) - {2 * n} + 2), lambda i: "
            f"substr({x}, i, {n}) = substr({x}, i + {n}, {n}){spared})[1]"
        )
        options.append(f"CASE WHEN {at} IS NOT NULL THEN {x}[1:{at} + {n} - 1] || {x}[{at} + {2 * n}:] END")
    return f"coalesce({', '.join(options)})"


def _repair_ctes(source: str, column: str, out: str) -> tuple[str, ...]:
    x = column
    settled = " OR ".join(
        f"(length(nm) >= {2 * n} AND right(nm, {n}) = substr(nm, length(nm) - {2 * n} + 1, {n}))" for n in range(2, 8)
    )
    cuts = ", ".join(
        f"CASE WHEN {n} < least(6, length(nm) // 2) AND length(nm) - {n} >= 3 AND contains(doc, left(nm, length(nm) - {n})) "
        f"THEN left(nm, length(nm) - {n}) END"
        for n in range(1, 6)
    )
    return (
        f"{out}_a AS (SELECT *, CASE WHEN length({x}) >= 4 THEN {_repair(x)} END AS fx FROM {source})",
        f"{out}_b AS (SELECT *, coalesce(fx, {x}) AS nm FROM {out}_a)",
        f"""{out} AS (SELECT * EXCLUDE (fx, nm) REPLACE (CASE WHEN length({x}) < 4 THEN {x}
            WHEN fx IS NOT NULL AND contains(doc, fx) THEN fx WHEN ({settled}) AND contains(doc, nm) THEN nm
            WHEN NOT contains(doc, nm) THEN coalesce({cuts}, nm) ELSE nm END AS {x}) FROM {out}_b)""",
    )


def _predicate(r: str, t: str) -> str:
    mapped = f"(CASE {r} WHEN '受控制' THEN '受控于' WHEN '接受' THEN '接收' WHEN '位于于' THEN '位于' ELSE {r} END)"
    return (
        f"CASE WHEN {mapped} = '部署' AND {_has_any(t, M.PLACE_TOKENS)} THEN '部署于' "
        f"WHEN {mapped} = '负责' AND length({t}) <= 10 THEN '任务' ELSE {mapped} END"
    )


COMPRESS = (
    f"""comp_a AS (SELECT *, {sql_edges('tail')} AS c0 FROM pred1)""",
    f"""comp_b AS (SELECT *, coalesce(
        nullif({sql_edges("CASE WHEN regexp_matches(c0, '^.+?(后|前|时|情况下)，') THEN regexp_replace(c0, '^.+?(后|前|时|情况下)，', '') ELSE '' END")}, ''),
        nullif({sql_edges("CASE WHEN regexp_matches(c0, '^.+?(后|前|时|情况下)') THEN regexp_replace(c0, '^.+?(后|前|时|情况下)', '') ELSE '' END")}, ''),
        c0) AS c1 FROM comp_a)""",
    f"""comp_c AS (SELECT *, CASE WHEN length(c1) > 24 THEN (SELECT arg_min(y, length(y) * 100000 + k) FROM (
        SELECT unnest(ys) AS y, generate_subscripts(ys, 1) AS k)) END AS clause FROM (SELECT *, list_filter(list_transform(
        string_split_regex(c1, '[；。]'), lambda y: {sql_edges('y')}), lambda y: y <> '') AS ys FROM comp_b))""",
    """comp_d AS (SELECT *, CASE WHEN length(clause) < length(c1) THEN clause ELSE c1 END AS c2 FROM comp_c)""",
    f"""compressed AS (SELECT doc_id, doc, relation_ord, head, relation, evidence, skill,
        CASE WHEN relation IN {_in(M.COMPRESSED_PREDICATES)} THEN coalesce(nullif({sql_edges(
            "regexp_extract(c2, '^(?:" + '|'.join(M.LEADING_VERBS) + ")(.+)$', 1)")}, ''), c2)
          ELSE tail END AS tail FROM comp_d)""",
)
CLEAN = (
    RELATIONS,
    f"""trimmed AS (SELECT r.doc_id, d.text AS doc, relation_ord, {sql_edges('head')} AS head,
      {sql_strip(sql_edges('relation'))} AS relation, {sql_edges('tail')} AS tail,
      {sql_strip('evidence')} AS evidence, {sql_strip('skill')} AS skill
      FROM rel r JOIN documents d USING (doc_id))""",
    *_repair_ctes("trimmed", "head", "fixed_head"),
    *_repair_ctes("fixed_head", "tail", "fixed"),
    f"pred1 AS (SELECT * REPLACE ({_predicate('relation', 'tail')} AS relation) FROM fixed)",
    *COMPRESS,
    f"cleaned AS (SELECT * REPLACE ({_predicate('relation', 'tail')} AS relation) FROM compressed)",
)
REASON = f"""CASE WHEN head = '' OR relation = '' OR tail = '' OR skill = '' THEN 'blank field'
  WHEN length(relation) > 12 THEN 'long predicate' WHEN head IN {_in(M.STOP_HEADS)} THEN 'stop head'
  WHEN relation IN ('为', '由', '是') THEN 'stop predicate'
  WHEN length(head) > 20 AND {_has_any('head', M.CLAUSE_MARKERS)} AND head NOT IN {_in(M.GENERIC_HEADS)} THEN 'clause head'
  WHEN length(tail) > 28 AND {_has_any('tail', M.BAD_TAIL_MARKERS)} THEN 'clause tail'
  WHEN head IN ('我方', '敌方') AND relation IN {_in(M.SIDE_PREDICATES)} THEN 'generic side'
  WHEN relation IN {_in(M.STOP_GOAL_PREDICATES)} THEN 'goal predicate'
  WHEN relation IN {_in([p for p in M.GENERIC_PREDICATES if p not in M.PREDICATE_REPLACEMENTS])} THEN 'generic predicate'
  WHEN skill NOT IN {_in(LANGS)} THEN 'unknown skill' END"""
REPLACED = (
    "CASE relation "
    + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in M.PREDICATE_REPLACEMENTS.items())
    + " ELSE relation END"
)


def _support(source: str) -> tuple[str, ...]:
    """``cited`` and the shortest supporting unit of every row of ``source``."""
    return (
        f"""ev_units AS (SELECT doc_id, u, k, {sql_compact('u')} AS c FROM (
          SELECT doc_id, unnest(a) AS u, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, list_filter(list_transform(
            string_split_regex(text, '[。！？!?；;\\n]+'), lambda x: {sql_edges('x')}), lambda x: x <> '') AS a FROM documents)))""",
        f"doc_compact AS (SELECT doc_id, {sql_compact('text')} AS dc FROM documents)",
        f"""searched AS (SELECT *, {sql_compact('head')} AS hc, {sql_compact('tail')} AS tc,
          {sql_compact('evidence')} AS ec FROM {source})""",
        """unit_hits AS (SELECT s.doc_id, s.relation_ord, arg_min(u.u, length(u.u) * 100000 + u.k) AS unit
          FROM searched s JOIN ev_units u ON u.doc_id = s.doc_id AND s.tc <> '' AND contains(u.c, s.tc)
            AND s.hc <> '' AND contains(u.c, s.hc) GROUP BY ALL)""",
        """supported AS (SELECT s.*, d.dc, h.unit, s.ec <> '' AND contains(d.dc, s.ec) AS cited
          FROM searched s JOIN doc_compact d USING (doc_id) LEFT JOIN unit_hits h USING (doc_id, relation_ord))""",
        f"""evidenced AS (SELECT *, coalesce((SELECT arg_min(e, length(e) * 10 + k) FROM (SELECT unnest([
              CASE WHEN evidence <> '' AND cited THEN {sql_strip('evidence')} END, unit,
              CASE WHEN contains(dc, {sql_compact('head || relation || tail')}) AND head || relation || tail <> ''
                THEN {sql_strip('head || relation || tail')} END]) AS e, unnest([1, 2, 3]) AS k) WHERE e <> ''), '') AS best
          FROM supported)""",
    )


RAW = (RELATIONS, "base AS (SELECT r.*, d.text AS doc FROM rel r JOIN documents d USING (doc_id))")


@query("m1_explode_relations", with_ctes(RELATIONS) + f"SELECT * REPLACE (CAST(relation_ord AS INTEGER) AS relation_ord) FROM rel")
def explode_relations(spark, sf_dir):
    return relation_rows(spark, sf_dir)


@query(
    "m2_repair_entities",
    with_ctes(*RAW, *_repair_ctes("base", "head", "fixed_head"), *_repair_ctes("fixed_head", "tail", "fixed"))
    + f"SELECT doc_id, {ORD}, head, tail FROM fixed",
)
def repair_entities(spark, sf_dir):
    rows = M.repair_entities(relation_rows(spark, sf_dir, witness=True))
    return rows.select("doc_id", "relation_ord", "head", "tail")


@query(
    "m3_normalize_predicates",
    with_ctes(RELATIONS) + f"SELECT doc_id, {ORD}, {_predicate(sql_strip('relation'), 'tail')} AS relation FROM rel",
)
def normalize_predicates(spark, sf_dir):
    return M.normalize_predicates(relation_rows(spark, sf_dir)).select("doc_id", "relation_ord", "relation")


@query(
    "m4_compress_tails",
    with_ctes(*RAW, "pred1 AS (SELECT * FROM base)", *COMPRESS) + f"SELECT doc_id, {ORD}, tail FROM compressed",
)
def compress_tails(spark, sf_dir):
    return M.compress_tails(relation_rows(spark, sf_dir)).select("doc_id", "relation_ord", "tail")


@query(
    "m5_sanitize_relations",
    with_ctes(
        *CLEAN,
        f"judged AS (SELECT *, {REASON} AS reason FROM cleaned)",
        f"passed AS (SELECT * REPLACE ({REPLACED} AS relation) FROM judged WHERE reason IS NULL)",
        *_support("passed"),
    )
    + f"""SELECT doc_id, {ORD}, head, relation, tail, best AS evidence, skill FROM evidenced
      WHERE cited OR unit IS NOT NULL""",
)
def sanitize_relations(spark, sf_dir):
    kept, _ = M.sanitize_relations(relation_rows(spark, sf_dir, witness=True), LANGS)
    return kept.select("doc_id", "relation_ord", *FIELDS)


@query(
    "m5_dropped_relations",
    with_ctes(
        *CLEAN,
        f"judged AS (SELECT *, {REASON} AS reason FROM cleaned)",
        f"passed AS (SELECT * REPLACE ({REPLACED} AS relation) FROM judged WHERE reason IS NULL)",
        *_support("passed"),
    )
    + f"""SELECT doc_id, {ORD}, reason FROM judged WHERE reason IS NOT NULL
      UNION ALL SELECT doc_id, {ORD}, 'not grounded' FROM supported WHERE NOT cited AND unit IS NULL""",
)
def dropped_relations(spark, sf_dir):
    _, dropped = M.sanitize_relations(relation_rows(spark, sf_dir, witness=True), LANGS)
    return dropped.select("doc_id", "relation_ord", "reason")


@query(
    "m6_ground_relations",
    with_ctes(*RAW, *_support("base")) + f"SELECT doc_id, {ORD} FROM supported WHERE cited OR unit IS NOT NULL",
)
def ground_relations(spark, sf_dir):
    return M.ground_relations(relation_rows(spark, sf_dir, witness=True)).select("doc_id", "relation_ord")


@query(
    "m7_select_evidence",
    with_ctes(*RAW, *_support("base")) + f"SELECT doc_id, {ORD}, best AS evidence FROM evidenced",
)
def select_evidence(spark, sf_dir):
    return M.select_evidence(relation_rows(spark, sf_dir, witness=True)).select("doc_id", "relation_ord", "evidence")


@query(
    "m8_expand_compound_tails",
    with_ctes(
        RELATIONS,
        f"""parts AS (SELECT *, list_filter(list_transform(string_split_regex({sql_edges('tail')}, '、|以及|及|与|和'),
          lambda x: {sql_edges('x')}), lambda x: x <> '') AS ps FROM rel)""",
        f"""hits AS (SELECT *, CASE WHEN relation IN {_in(M.SPLIT_PREDICATES)} AND skill IN ('en', 'fr')
          AND len(ps) >= 2 AND len(list_filter(ps, lambda x: length(x) > 24)) = 0
          THEN list_filter(ps, lambda x: contains(evidence, x)) ELSE [] END AS us FROM parts)""",
        "tails AS (SELECT *, CASE WHEN len(us) >= 2 THEN us ELSE [tail] END AS ts FROM hits)",
    )
    + f"""SELECT doc_id, {ORD}, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS part_ord, unnest(ts) AS tail FROM tails""",
)
def expand_compound_tails(spark, sf_dir):
    rows = M.expand_compound_tails(relation_rows(spark, sf_dir), ("en", "fr"))
    return rows.select("doc_id", "relation_ord", "part_ord", "tail")


KEYED = f"""keyed AS (SELECT *, {sql_compact('head')} AS kh, {sql_compact('relation')} AS kr, {sql_compact('tail')} AS kt,
  {sql_compact('skill')} AS ks FROM rel WHERE {sql_compact('head')} <> '' AND {sql_compact('relation')} <> ''
  AND {sql_compact('tail')} <> '')"""


@query(
    "m9_dedup_exact",
    with_ctes(RELATIONS, KEYED)
    + """SELECT doc_id, CAST(min(relation_ord) AS INTEGER) AS relation_ord, arg_min(head, relation_ord) AS head,
      arg_min(relation, relation_ord) AS relation, arg_min(tail, relation_ord) AS tail, arg_min(skill, relation_ord) AS skill,
      coalesce(arg_min(evidence, length(evidence) * 1000000 + relation_ord) FILTER (evidence <> ''), '') AS evidence
      FROM keyed GROUP BY doc_id, kh, kr, kt, ks""",
)
def dedup_exact(spark, sf_dir):
    return M.dedup_exact(relation_rows(spark, sf_dir))


# the SQL edit distance counts bytes, so every letter outside ASCII gets a one-byte stand-in
# that occurs in no head or tail
WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü、主到制前区压和我方标目要达，；"
NARROW = ("".join(map(chr, (*range(1, 9), *range(14, 28)))) + "./:;<>?@[]^_`{}~")[: len(WIDE)]


def _similar(a: str, b: str) -> str:
    narrow = lambda x: f"translate({x}, {q(WIDE)}, {q(NARROW)})"
    return (
        f"({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR (abs(length({a}) - length({b})) <= 3 "
        f"AND levenshtein({narrow(a)}, {narrow(b)}) <= 2))"
    )


@query(
    "m10_fuzzy_pairs",
    with_ctes(RELATIONS, KEYED)
    + f"""SELECT r.doc_id, CAST(r.relation_ord AS INTEGER) AS relation_ord, CAST(min(l.relation_ord) AS INTEGER) AS match_relation_ord,
      count(*) AS match_count FROM keyed l JOIN keyed r ON l.doc_id = r.doc_id AND l.kr = r.kr AND l.ks = r.ks
      AND l.relation_ord < r.relation_ord AND {_similar('l.kh', 'r.kh')} AND {_similar('l.kt', 'r.kt')} GROUP BY r.doc_id, r.relation_ord""",
)
def fuzzy_pairs(spark, sf_dir):
    return Z.fuzzy_pairs(relation_rows(spark, sf_dir))


def _fold(source: str) -> tuple[str, ...]:
    """The merge as a recursion: step n takes the n-th row of every block into the list of survivors.

    A survivor has its key (kh, kt) and its place in the search order; both are null once
    another survivor has taken the key over.
    """
    fields = ("at", "head", "relation", "tail", "evidence", "skill", "kh", "kt", "place")
    struct = lambda values: "{" + ", ".join(f"'{f}': {v}" for f, v in zip(fields, values)) + "}"
    own = struct(["x.relation_ord", "x.head", "x.relation", "x.tail", "x.evidence", "x.skill", "x.kh", "x.kt", "x.n"])
    changed = struct(["s.at", "nh", "s.relation", "nt", "ne", "s.skill", "rh", "rt", "rp"])
    keyless = struct([*(f"s.{f}" for f in fields[:6]), "NULL", "NULL", "NULL"])
    place = lambda test: f"list_min(list_transform(list_filter(f.kept, lambda s: {test}), lambda s: s.place))"
    near = f"s.place IS NOT NULL AND {_similar('s.kh', 'x.kh')} AND {_similar('s.kt', 'x.kt')}"
    return (
        f"""seq AS (SELECT doc_id, kr, ks, relation_ord, head, relation, tail, {sql_strip('evidence')} AS evidence, skill, kh, kt,
          CAST(row_number() OVER (PARTITION BY doc_id, kr, ks ORDER BY relation_ord) AS INTEGER) AS n FROM {source})""",
        f"""fold AS (
          SELECT doc_id, kr, ks, n, [{own}] AS kept FROM seq x WHERE n = 1
          UNION ALL
          SELECT doc_id, kr, ks, n, CASE WHEN p IS NULL THEN list_append(kept, own) ELSE list_transform(kept, lambda s:
            CASE WHEN s.place = p THEN {changed} WHEN s.kh = rh AND s.kt = rt THEN {keyless} ELSE s END) END
          FROM (SELECT *, CASE WHEN moved THEN nh ELSE old.kh END AS rh, CASE WHEN moved THEN nt ELSE old.kt END AS rt,
              CASE WHEN moved THEN coalesce(list_min(list_transform(list_filter(kept, lambda s: s.kh = nh AND s.kt = nt),
                lambda s: s.place)), n) ELSE old.place END AS rp
            FROM (SELECT *, NOT exact AND (nh <> old.kh OR nt <> old.kt) AS moved
              FROM (SELECT *, CASE WHEN NOT exact AND length(own.kh) > length(old.kh) THEN own.kh ELSE old.head END AS nh,
                  CASE WHEN NOT exact AND length(own.kt) > length(old.kt) THEN own.kt ELSE old.tail END AS nt,
                  CASE WHEN own.evidence <> '' AND (coalesce(old.evidence, '') = '' OR length(own.evidence) < length(old.evidence))
                    THEN own.evidence ELSE old.evidence END AS ne
                FROM (SELECT *, coalesce(old.kh = own.kh AND old.kt = own.kt, false) AS exact
                  FROM (SELECT *, list_filter(kept, lambda s: s.place = p)[1] AS old
                    FROM (SELECT f.doc_id, f.kr, f.ks, x.n, f.kept, {own} AS own,
                        coalesce({place('s.kh = x.kh AND s.kt = x.kt')}, {place(near)}) AS p
                      FROM fold f JOIN seq x ON x.doc_id = f.doc_id AND x.kr = f.kr AND x.ks = f.ks AND x.n = f.n + 1)))))))""",
        """survivors AS (SELECT doc_id, unnest(kept) AS s FROM (
          SELECT doc_id, arg_max(kept, n) AS kept FROM fold GROUP BY doc_id, kr, ks))""",
    )


SURVIVORS = """SELECT doc_id, CAST(s.at AS INTEGER) AS relation_ord, s.head AS head, s.relation AS relation, s.tail AS tail,
  s.evidence AS evidence, s.skill AS skill FROM survivors"""


@query("m11_merge_fuzzy", with_ctes(RELATIONS, KEYED, *_fold("keyed")) + SURVIVORS)
def merge_fuzzy(spark, sf_dir):
    return Z.merge_fuzzy(relation_rows(spark, sf_dir))


@query(
    "m12_merge_relations",
    with_ctes(
        *CLEAN,
        f"judged AS (SELECT *, {REASON} AS reason FROM cleaned)",
        f"passed AS (SELECT * REPLACE ({REPLACED} AS relation) FROM judged WHERE reason IS NULL)",
        *_support("passed"),
        "clean AS (SELECT doc_id, relation_ord, head, relation, tail, best AS evidence, skill FROM evidenced WHERE cited OR unit IS NOT NULL)",
        KEYED.replace("keyed AS", "clean_keys AS").replace("FROM rel ", "FROM clean "),
        *_fold("clean_keys"),
    )
    + SURVIVORS.replace("AS relation_ord,", "AS relation_ord, 0 AS part_ord,"),
)
def merge_relations(spark, sf_dir):
    return Z.merge_relations(relation_rows(spark, sf_dir, witness=True), skills=LANGS)


CONFIDENCE = (
    *RAW,
    f"doc_compact AS (SELECT doc_id, {sql_compact('text')} AS dc FROM documents)",
    f"""graded AS (SELECT b.*, least(100,
      CASE WHEN length(evidence) BETWEEN 4 AND 120 THEN 25 WHEN evidence <> '' THEN 10 ELSE 0 END
      + CASE WHEN evidence = '' THEN 0 WHEN contains(evidence, head) AND contains(evidence, tail) THEN 30
          WHEN contains(evidence, head) OR contains(evidence, tail) THEN 10 ELSE 0 END
      + CASE WHEN relation IN {_in(M.KNOWN_PREDICATES)} THEN 20 ELSE 0 END
      + CASE WHEN length(head) BETWEEN 1 AND 16 AND length(tail) BETWEEN 1 AND 20 THEN 15
          WHEN length(head) <= 20 AND length(tail) <= 24 THEN 5 ELSE 0 END
      + CASE WHEN {sql_compact('evidence')} <> '' AND contains(dc, {sql_compact('evidence')}) THEN 10 ELSE 0 END) AS points
      FROM base b JOIN doc_compact USING (doc_id))""",
)


@query(
    "m13_score_confidence",
    with_ctes(*CONFIDENCE) + f"SELECT doc_id, {ORD}, CAST(points / 100.0 AS DOUBLE) AS confidence FROM graded",
)
def score_confidence(spark, sf_dir):
    rows = M.score_confidence(relation_rows(spark, sf_dir, witness=True))
    return rows.select("doc_id", "relation_ord", "confidence")


@query(
    "m14_split_by_confidence",
    with_ctes(*CONFIDENCE)
    + f"SELECT doc_id, {ORD}, CASE WHEN points >= 50 THEN 'high' ELSE 'low' END AS side FROM graded",
)
def split_by_confidence(spark, sf_dir):
    high, low = M.split_by_confidence(relation_rows(spark, sf_dir, witness=True))
    side = lambda df, name: df.select("doc_id", "relation_ord", F.lit(name).alias("side"))
    return side(high, "high").unionByName(side(low, "low"))


def review_inputs(spark, sf_dir):
    """Predictions, texts and replies: the last relations of a document come back changed."""
    docs = relation_docs(spark, sf_dir)
    changed = F.transform(
        "relations", lambda r: r.withField("relation", F.lit("位于"))
    )
    replies = docs.select("doc_id", "lang", changed.alias("relations"))
    # English documents come back from the targeted review, French ones from the full one
    return docs, replies.filter("lang = 'en'").drop("lang"), replies.filter("lang = 'fr'").drop("lang")


def _reviewed(spark, sf_dir):
    docs, targeted, proofread = review_inputs(spark, sf_dir)
    return V.apply_review(M.explode_relations(docs), docs, targeted, proofread, LANGS)


@query("m15_apply_review")
def apply_review(spark, sf_dir):
    return _reviewed(spark, sf_dir)[0]


@query("m15_review_counts")
def review_counts(spark, sf_dir):
    return _reviewed(spark, sf_dir)[1]


@query("m16_merge_chunks")
def merge_chunks(spark, sf_dir):
    docs, summaries, _ = review_inputs(spark, sf_dir)
    rows = M.explode_relations(docs).withColumn("chunk_index", F.floor(F.col("relation_ord") / 10).cast("int"))
    counts = docs.select("doc_id", (F.floor(F.size("relations") / 10) + 1).alias("chunk_count"))
    return V.merge_chunks(rows, counts, summaries, skills=LANGS)


@query("m16_merge_chunks_fast")
def merge_chunks_fast(spark, sf_dir):
    docs, _, _ = review_inputs(spark, sf_dir)
    rows = M.explode_relations(docs).withColumn("chunk_index", F.floor(F.col("relation_ord") / 10).cast("int"))
    counts = docs.select("doc_id", (F.floor(F.size("relations") / 10) + 1).alias("chunk_count"))
    return V.merge_chunks(rows, counts, None, docs, True, LANGS)


# ---- replies --------------------------------------------------------------------------------
NOTES = '["x", {"y": [[{"z": [[{"u": [[[[{"v": 1}]]]]}]]}]]}]'


def reply_docs(spark, sf_dir, wrapper: str = "relation_list", fields=("head", "relation", "tail")):
    """Replies built from the sentences: plain, fenced, chatty, or cut off."""
    docs = relation_docs(spark, sf_dir)
    plain = lambda c: F.regexp_replace(c, "[^A-Za-z0-9 ]", "")
    source = ("head", "skill", "evidence")

    def item(r):
        parts = [F.lit("{")]
        for i, (name, field) in enumerate(zip(fields, source)):
            parts += [F.lit(f'{", " if i else ""}"{name}": "{"{" if i == 2 else ""}'), plain(r[field]), F.lit('"')]
        return F.concat(*parts, F.lit(f', "notes": {NOTES}}}'))

    body = F.array_join(F.transform("relations", item), ", ")
    whole = F.concat(F.lit(f'{{"{wrapper}": ["odd", '), body, F.lit("]}"))
    cut = F.substring(whole, F.lit(1), F.floor(F.char_length(whole) * 2 / 3).cast("int"))
    d = F.col("doc_id") % 5
    reply = (
        F.when(d == 0, whole)
        .when(d == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(d == 2, F.concat(F.lit("<think>{no}\n</think> Here: "), whole, F.lit(" done")))
        .when(d == 3, cut)
        .otherwise(F.concat(F.lit("["), body, F.lit("]")))
    )
    return docs.select("doc_id", reply.alias("reply"))


# an item reads {"head": "H", "relation": "R", "tail": "{T", "notes": [...]}; a stray string comes first
PARSED = (
    RELATIONS,
    f"""items AS (SELECT doc_id, relation_ord, regexp_replace(head, '[^A-Za-z0-9 ]', '', 'g') AS head,
      regexp_replace(skill, '[^A-Za-z0-9 ]', '', 'g') AS relation,
      '{{' || regexp_replace(evidence, '[^A-Za-z0-9 ]', '', 'g') AS tail FROM rel)""",
    f"""sized AS (SELECT *, length('{{"head": "", "relation": "", "tail": "", "notes": {NOTES}}}') + length(head) + length(relation)
      + length(tail) + 2 AS n FROM items)""",
    """placed AS (SELECT *, 26 + sum(n) OVER (PARTITION BY doc_id ORDER BY relation_ord) - 2 AS stop,
      (26 + sum(n) OVER (PARTITION BY doc_id) - 2 + 2) * 2 // 3 AS cut FROM sized)""",
)


@query(
    "p7_parse_responses",
    with_ctes(*PARSED)
    + f"""SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'outer' WHEN 3 THEN 'recovered' ELSE 'full' END AS parse_mode,
      {ORD}, head, relation, tail FROM placed WHERE doc_id % 5 < 3 OR (doc_id % 5 = 3 AND stop <= cut)""",
)
def parse_responses(spark, sf_dir):
    parsed, _ = P.split_parsed(P.parse_responses(reply_docs(spark, sf_dir)))
    rows = parsed.select("doc_id", "parse_mode", posexplode("relations").alias("relation_ord", "r"))
    return rows.select("doc_id", "parse_mode", "relation_ord", "r.head", "r.relation", "r.tail")


@query(
    "p7_rejected_responses",
    """SELECT doc_id, 'rejected' AS parse_mode FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 'full' FROM documents WHERE doc_id % 2 = 1""",
)
def rejected_responses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("not json: "), F.regexp_replace("text", "[{}\\[\\]]", "")))
        .otherwise('{"relation_list":[]}')
        .alias("reply"),
    )
    good, bad = P.split_parsed(P.parse_responses(docs))
    return good.unionByName(bad).select("doc_id", "parse_mode")


@query(
    "p8_parse_triples",
    with_ctes(RELATIONS)
    + f"""SELECT doc_id, {ORD}, regexp_replace(head, '[^A-Za-z0-9 ]', '', 'g') AS subject,
      regexp_replace(skill, '[^A-Za-z0-9 ]', '', 'g') AS relation,
      '{{' || regexp_replace(evidence, '[^A-Za-z0-9 ]', '', 'g') AS object FROM rel WHERE doc_id % 5 <> 3""".replace(
        "AS relation_ord", "AS triple_ord"
    ),
)
def parse_triples(spark, sf_dir):
    replies = reply_docs(spark, sf_dir, "relations", ("subject", "relation", "object"))
    return P.parse_triples(replies, "reply")


@query(
    "p9_with_extractor",
    """SELECT doc_id, CASE WHEN text = '' THEN '{"relation_list": []}' ELSE '{"n": ' || length(text) || '}' END AS reply
      FROM documents""",
)
def with_extractor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return P.with_extractor(docs, lambda text: f'{{"n": {len(text)}}}', key="doc_id")


# ---- coreference ------------------------------------------------------------------------------
def alias_docs(spark, sf_dir):
    """Documents with alias replies: valid groups, a too short name, a non-list value."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.transform(F.split("text", " "), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: w != "")
    word = lambda w: F.coalesce(w, F.lit(""))
    longer = F.filter("_w", lambda w: F.char_length(w) >= 5)
    reply = F.concat(
        F.lit('Here it is:\n```json\n{"FIRST": ["'), word(F.array_min("_w")), F.lit('", "x", " '), word(F.array_max("_w")),
        F.lit('"], "y": ["abc"], "n": "abc", "SECOND": ["'), word(F.array_min(longer)), F.lit('", "SECOND", "the"]}\n```'),
    )
    docs = docs.withColumn("_w", words)
    return docs.select("doc_id", "text", reply.alias("reply"))


ALIASES = (
    """cleaned AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, ' '),
      lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '') AS w FROM documents)""",
    """raw AS (SELECT doc_id, text, unnest([coalesce(list_min(w), ''), 'x', coalesce(list_max(w), '')]) AS alias, 0 AS g,
        unnest([0, 1, 2]) AS a, 'FIRST' AS canonical FROM cleaned
      UNION ALL SELECT doc_id, text, unnest([coalesce(list_min(list_filter(w, lambda x: length(x) >= 5)), ''), 'SECOND', 'the']), 1,
        unnest([0, 1, 2]), 'SECOND' FROM cleaned)""",
    """valid AS (SELECT doc_id, text, canonical, alias, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS group_ord,
      row_number() OVER (PARTITION BY doc_id, g ORDER BY a) - 1 AS alias_ord FROM raw WHERE length(alias) >= 2 AND alias <> canonical)""",
)


@query(
    "c1_valid_aliases",
    with_ctes(*ALIASES)
    + """SELECT doc_id, CAST(group_ord AS INTEGER) AS group_ord, canonical, CAST(alias_ord AS INTEGER) AS alias_ord, alias FROM valid""",
)
def valid_aliases(spark, sf_dir):
    return C.valid_aliases(alias_docs(spark, sf_dir))


@query(
    "c2_apply_aliases",
    with_ctes(
        *ALIASES,
        """steps AS (SELECT doc_id, alias, canonical, row_number() OVER (PARTITION BY doc_id
          ORDER BY group_ord, length(alias) DESC, alias_ord) AS n FROM valid)""",
        f"""folded AS (SELECT doc_id, 0 AS n, text FROM documents WHERE {sql_tokens('text')} > 50
          UNION ALL SELECT f.doc_id, s.n, replace(f.text, s.alias, s.canonical) FROM folded f JOIN steps s
            ON s.doc_id = f.doc_id AND s.n = f.n + 1)""",
    )
    + f"""SELECT doc_id, CAST(CASE WHEN {sql_tokens('d.text')} > 50 THEN coalesce(g.n, 0) ELSE 0 END AS INTEGER) AS coref_groups,
      coalesce(f.text, d.text) AS text FROM documents d LEFT JOIN (SELECT doc_id, arg_max(text, n) AS text FROM folded GROUP BY doc_id) f
      USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT canonical) AS n FROM valid GROUP BY doc_id) g USING (doc_id)""",
)
def apply_aliases(spark, sf_dir):
    return C.apply_aliases(alias_docs(spark, sf_dir), 50).select("doc_id", "coref_groups", "text")
