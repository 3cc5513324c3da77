"""The operators applied to their whole tables with production parameters, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.llm import (
    bpe, covertree, decontaminate, exact_dedup, langid, manifest, packing, pii, quality, simhash, spelling, suffix_dedup, toxicity,
)
from relmill.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_simhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"))
    coded = coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(coded).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ["doc_id", "held_out"])


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query("op8_importance_resampling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select_by_importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


@query("op10_packed_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op1_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, d.vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v)
        WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes; the byte table follows the polynomial."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substring(hex(encode({text})), CAST(2 * i - 1 AS INTEGER), 2))::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, ({entries}::BIGINT[])[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), {step}), 4294967295::BIGINT)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g ON d.t = g.t
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zÀ-ÿ]{{7,}}')) AS run
        FROM documents WHERE text IS NOT NULL
    ), counted AS (SELECT id || ':' || run AS name, run, count(*) AS n FROM runs GROUP BY ALL
    ), hashed AS (SELECT run, n, {crc32_sql("name")} AS h FROM counted
    ), words AS (
        SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2)
                    ELSE run END AS word, n
        FROM hashed
    ), vocabulary AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), without AS MATERIALIZED (
        SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
    ), near AS MATERIALIZED (
        SELECT DISTINCT a.word, b.word AS other, b.n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION
        SELECT a.rest, a.word, a.n FROM without a JOIN vocabulary v ON a.rest = v.word
        UNION
        SELECT v.word, a.rest, v2.n FROM without a JOIN vocabulary v ON a.word = v.word JOIN vocabulary v2 ON a.rest = v2.word
    ), best AS (
        SELECT word, count(*) AS n_near, max(n) AS top,
               arg_min(other, (-n, other)) AS other
        FROM near GROUP BY word
    ), formed AS MATERIALIZED (
        SELECT v.word, CASE WHEN b.top >= 10 * v.n THEN b.other END AS form, v.n, coalesce(b.n_near, 0) AS n_near,
               CASE WHEN b.top >= 10 * v.n THEN b.top END AS form_n
        FROM vocabulary v LEFT JOIN best b ON b.word = v.word
    ), steps AS (
        SELECT word, word AS root FROM formed
        UNION ALL
        SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
    ), last AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL)
    SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN last l ON l.word = f.word
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS MATERIALIZED (
        SELECT doc_id, coalesce('=' || source, '') AS tree, leaf, presented,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM (
            SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
                   CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0
                        THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS presented
            FROM documents
        )
    ), low AS (
        SELECT 0 AS level, tree, pos, count(*) OVER (PARTITION BY tree) AS width, leaf AS digest FROM leaves
        UNION ALL
        SELECT level + 1, tree, pos // 3, (width + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM low WHERE width > 1 GROUP BY level, tree, pos // 3, width
    ), subroots AS MATERIALIZED (
        SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM low WHERE width = 1
    ), high AS (
        SELECT 0 AS level, place AS pos, count(*) OVER () AS width, subroot AS digest FROM subroots
        UNION ALL
        SELECT level + 1, pos // 3, (width + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM high WHERE width > 1 GROUP BY level, pos // 3, width
    ), nodes AS MATERIALIZED (
        SELECT 0 AS upper, tree, level, pos, digest FROM low WHERE width > 1
        UNION ALL SELECT 1, '', level, pos, digest FROM high WHERE width > 1
    ), paths AS (
        SELECT l.tree, l.pos, n.upper, n.level, n.pos AS place, n.digest, n.pos = l.pos // CAST(3 ** n.level AS BIGINT) AS own
        FROM leaves l JOIN nodes n ON n.upper = 0 AND n.tree = l.tree AND n.pos // 3 = l.pos // CAST(3 ** (n.level + 1) AS BIGINT)
        UNION ALL
        SELECT l.tree, l.pos, n.upper, n.level, n.pos, n.digest, n.pos = s.place // CAST(3 ** n.level AS BIGINT)
        FROM leaves l JOIN subroots s ON s.tree = l.tree
        JOIN nodes n ON n.upper = 1 AND n.pos // 3 = s.place // CAST(3 ** (n.level + 1) AS BIGINT)
    ), steps AS MATERIALIZED (
        SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY upper, level) AS step,
               coalesce(string_agg(digest, '' ORDER BY place) FILTER (NOT own AND place < mine), '') AS before,
               coalesce(string_agg(digest, '' ORDER BY place) FILTER (NOT own AND place > mine), '') AS after
        FROM (SELECT *, max(place) FILTER (own) OVER (PARTITION BY tree, pos, upper, level) AS mine FROM paths)
        GROUP BY tree, pos, upper, level
    ), fold AS (
        SELECT tree, pos, CAST(0 AS BIGINT) AS step, presented AS digest FROM leaves
        UNION ALL
        SELECT f.tree, f.pos, s.step, sha256(s.before || f.digest || s.after)
        FROM fold f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step + 1
    ), ends AS (SELECT tree, pos, arg_max(digest, step) AS folded_root FROM fold GROUP BY tree, pos
    ), proofs AS (SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY tree, pos)
    SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
           e.folded_root, e.folded_root = r.digest AS verified
    FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN high r ON r.width = 1
    JOIN ends e ON e.tree = l.tree AND e.pos = l.pos LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    cleared = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    presented = manifest.leaf([*manifest.FIELDS[:-1], cleared])
    rows = manifest.witnesses(manifest.append(docs, carry={"presented": presented}), ["presented"])
    rows = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof().alias("proof_sha256"), manifest.folded("presented").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
