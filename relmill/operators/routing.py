"""Routing documents and chunks to skills by weighted keyword counts.

Scores are one wide projection over the text (no cross join, no shuffle). Ranking, the
rule route and the reroute test work on the score array of the same row. Only the route
cache and model replies are joined, on a text hash, with narrow rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import inline, posexplode
from relmill.functions.text import doc_hash, let, occurrences, unique_values
from relmill.operators.responses import reply_object
from relmill.operators.skills import Skill
from relmill.plans.store import stored

# ---- fixed values: thresholds, texts ------------------------------------------------------
PRIMARY_MIN = 1.0
AUX_MIN = 1.0
AUX_MIN_FALLBACK = 2.0
CONFIDENT_TOP = 3.0
CONFIDENT_MARGIN = 1.0
REROUTE_MIN = 2.0
REROUTE_MARGIN = 2.0
LONG_KEYWORD = 4
LONG_KEYWORD_FACTOR = 1.5
MAX_SKILLS = 3
REASON_MATCH = "规则路由：根据关键词加权分数选择 %s。加权分数：%s。"
REASON_RECALL = "规则路由：无明显关键词信号，为保证召回选择 %s。加权分数：%s。"
REASON_REUSED = "复用文档级路由；chunk 关键词分数未显示明显偏离。"
REASON_CACHED = "命中路由缓存。"
MODE_RULE = "keyword_rule"
MODE_MODEL = "llm_router"
MODE_CACHED = "legacy_llm_cache"
MODE_REUSED = "document_reused"
MODE_REROUTED = "chunk_rerouted"
# -----------------------------------------------------------------------------------------
SCORES_TYPE = "array<struct<skill:string,ord:int,score:double>>"
ROUTE_TYPE = (
    f"struct<selected_skills:array<string>,scores:{SCORES_TYPE},router_reason:string,"
    "router_mode:string>"
)


# ---- scores -------------------------------------------------------------------------------
def keyword_idf(keywords: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """``ln(skills / hits) + 1`` per keyword of a ``(skill, keyword)`` table; repeats count.

    ``skills`` is the registry (``name``), which also counts skills without keywords; if it
    is not given, the skills of ``keywords`` are counted.
    """
    names = keywords.select(F.col("skill").alias("name")) if skills is None else skills
    total = names.select(F.count_distinct("name")).scalar()
    return (
        keywords.filter(F.col("keyword") != "")
        .groupBy("keyword")
        .agg(F.count("*").alias("hits"))
        .select("keyword", "hits", (F.log(total / F.col("hits")) + 1.0).alias("idf"))
    )


def keyword_weights(skills: Sequence[Skill]) -> dict[str, float]:
    hits = Counter(k for s in skills for k in s.keywords if k)
    return {
        k: (math.log(len(skills) / n) + 1.0)
        * (LONG_KEYWORD_FACTOR if len(k) >= LONG_KEYWORD else 1.0)
        for k, n in hits.items()
    }


def _weighted_sum(text: Column, entries: list[tuple[str, float]]) -> Column:
    """A balanced tree of sums: flat enough for the optimizer whatever the size of the lexicon."""
    if not entries:
        return F.lit(0.0)
    if len(entries) == 1:
        keyword, weight = entries[0]
        return occurrences(text, keyword) * F.lit(float(weight))
    half = len(entries) // 2
    return _weighted_sum(text, entries[:half]) + _weighted_sum(text, entries[half:])


def score_array(text: Column, skills: Sequence[Skill], weighted: bool = True) -> Column:
    """``ARRAY<STRUCT<skill, ord, score>>`` in registry order, zero scores included."""
    weights = keyword_weights(skills)
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("skill"),
                F.lit(i).alias("ord"),
                F.round(
                    _weighted_sum(
                        text, [(k, weights[k] if weighted else 1.0) for k in s.keywords if k]
                    ),
                    2,
                ).alias("score"),
            )
            for i, s in enumerate(skills)
        ]
    )


def keyword_scores(df: DataFrame, skills: Sequence[Skill], text: str = "text") -> DataFrame:
    return df.withColumn("scores", score_array(F.col(text), skills))


def keyword_counts(df: DataFrame, skills: Sequence[Skill], text: str = "text") -> DataFrame:
    return df.withColumn("scores", score_array(F.col(text), skills, weighted=False))


def score_rows(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return df.select(*keep, inline("scores")).withColumnRenamed("ord", "skill_ord")


# ---- selection ----------------------------------------------------------------------------
def ranked(scores: Column) -> Column:
    """Score array ordered by score (high first), registry order breaking ties."""
    keyed = F.transform(
        scores,
        lambda s: F.struct(
            (-s["score"]).alias("neg"),
            s["ord"].alias("ord"),
            s["skill"].alias("skill"),
            s["score"].alias("score"),
        ),
    )
    return F.array_sort(keyed)


def rule_selection(
    scores: Column,
    max_skills: int = MAX_SKILLS,
    aux_min: float = AUX_MIN,
    primary_min: float | None = PRIMARY_MIN,
) -> Column:
    """Names of the best skill and the auxiliary ones; without signal simply the first."""

    def choose(r: Column) -> Column:
        passed = F.filter(r, lambda s, i: (i == 0) | (s["score"] >= aux_min))
        picked = passed
        if primary_min is not None:
            top = F.coalesce(F.get(r, F.lit(0))["score"], F.lit(0.0))
            picked = F.when(top < primary_min, r).otherwise(passed)
        return F.slice(F.transform(picked, lambda s: s["skill"]), 1, max_skills)

    return let(ranked(scores), choose)


def wants_model(scores: Column) -> Column:
    """No or weak signal, or two skills too close to call; false without scores."""

    def decide(r: Column) -> Column:
        top = F.get(r, F.lit(0))["score"]
        second = F.coalesce(F.get(r, F.lit(1))["score"], F.lit(0.0))
        unclear = (second >= AUX_MIN) & (top - second < CONFIDENT_MARGIN)
        return F.when(F.size(r) == 0, False).otherwise((top < CONFIDENT_TOP) | unclear)

    return let(ranked(scores), decide)


def general_number(score: Column) -> Column:
    """Six significant digits without trailing zeros, scientific from a million on."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(score))).cast("int"))
    fixed = F.format_string("%.6f", F.round(F.lit(1.0) * score, 2))
    short = F.when(F.abs(score) < 10000, fixed).otherwise(
        F.format_string("%.6f", F.when(digits >= 1, F.round(score, 1)).otherwise(F.round(score, 0)))
    )
    plain = F.regexp_replace(short, r"\.?0+$", "")
    science = F.regexp_replace(F.format_string("%.5e", score), r"\.?0+e", "e")
    return (
        F.when(score == 0, "0").when(F.abs(score) >= 999999.5, science).otherwise(plain)
    )


def reason_text(scores: Column, selected: Column) -> Column:
    names = F.array_join(selected, "、")
    listed = F.array_join(
        F.transform(scores, lambda s: F.concat(s["skill"], F.lit("="), general_number(s["score"]))),
        "，",
    )
    top = F.coalesce(F.array_max(F.transform(scores, lambda s: s["score"])), F.lit(0.0))
    return F.when(top < PRIMARY_MIN, F.format_string(REASON_RECALL, names, listed)).otherwise(
        F.format_string(REASON_MATCH, names, listed)
    )


def select_skills(df: DataFrame, max_skills: int = MAX_SKILLS) -> DataFrame:
    return df.withColumn("selected_skills", rule_selection(F.col("scores"), max_skills))


def select_skills_fallback(df: DataFrame, max_skills: int = MAX_SKILLS) -> DataFrame:
    """Stricter variant: the best skill plus others scoring at least two."""
    return df.withColumn(
        "selected_skills",
        rule_selection(F.col("scores"), max_skills, AUX_MIN_FALLBACK, primary_min=None),
    )


def needs_model_route(df: DataFrame) -> DataFrame:
    return df.withColumn("needs_model", wants_model(F.col("scores")))


def route_reason(df: DataFrame) -> DataFrame:
    return df.withColumn("router_reason", reason_text(F.col("scores"), F.col("selected_skills")))


# ---- routes -------------------------------------------------------------------------------
def known_names(names: Column, skills: Sequence[Skill]) -> Column:
    return F.filter(
        unique_values(names), lambda n: n.isin([s.name for s in skills])
    )


def resolve_model_route(
    replies: DataFrame, skills: Sequence[Skill], max_skills: int = MAX_SKILLS, reply: str = "reply"
) -> DataFrame:
    """Parse router replies; ``model_skills`` is null where nothing usable came back."""
    parsed = replies.withColumn(
        "_r",
        F.from_json(
            reply_object(F.col(reply)),
            "primary_skill string, aux_skills array<string>, reason string",
        ),
    )
    proposed = F.concat(
        F.array(F.col("_r.primary_skill")), F.coalesce("_r.aux_skills", F.array().cast("array<string>"))
    )
    picked = F.slice(known_names(proposed, skills), 1, max_skills)
    return (
        parsed.withColumn("_picked", picked)
        .withColumn("model_skills", F.when(F.size("_picked") > 0, F.col("_picked")))
        .withColumn("model_reason", F.coalesce("_r.reason", F.lit("")))
        .drop("_r", "_picked")
    )


def route_documents(
    df: DataFrame,
    skills: Sequence[Skill],
    cache: DataFrame | None = None,
    model_routes: DataFrame | None = None,
    max_skills: int = MAX_SKILLS,
) -> DataFrame:
    """Route rows that carry ``doc_hash`` and ``scores``: cache > model > rules.

    ``cache`` is keyed by ``doc_hash`` (struct ``route``), ``model_routes`` by
    ``doc_hash`` with ``model_skills``/``model_reason``. Pass narrow rows: the text is not
    needed here, so only hashes and scores move through the joins. Many copies of one text
    share a hash; adaptive skew handling may split that side freely because each lookup
    table holds one row per hash.
    """
    out = df
    if cache is not None:
        out = out.join(cache.select("doc_hash", F.col("route").alias("_cached")), "doc_hash", "left")
    else:
        out = out.withColumn("_cached", F.lit(None).cast(ROUTE_TYPE))
    if model_routes is not None:
        out = out.join(
            model_routes.select("doc_hash", "model_skills", "model_reason"), "doc_hash", "left"
        )
    else:
        out = out.withColumn("model_skills", F.lit(None).cast("array<string>")).withColumn(
            "model_reason", F.lit(None).cast("string")
        )
    cached = known_names(
        F.coalesce(F.col("_cached.selected_skills"), F.array().cast("array<string>")), skills
    )
    out = out.withColumn("_hit", cached).withColumn(
        "_rule", rule_selection(F.col("scores"), max_skills)
    )
    hit = F.size("_hit") > 0
    model = ~hit & wants_model(F.col("scores")) & F.col("model_skills").isNotNull()
    return out.select(
        *[c for c in df.columns if c != "scores"],
        F.when(hit, F.col("_hit"))
        .when(model, F.col("model_skills"))
        .otherwise(F.col("_rule"))
        .alias("selected_skills"),
        F.when(hit, F.coalesce("_cached.scores", "scores")).otherwise(F.col("scores")).alias("scores"),
        F.when(hit, F.coalesce("_cached.router_reason", F.lit(REASON_CACHED)))
        .when(model, F.col("model_reason"))
        .otherwise(reason_text(F.col("scores"), F.col("_rule")))
        .alias("router_reason"),
        F.when(hit, F.coalesce("_cached.router_mode", F.lit(MODE_CACHED)))
        .when(model, F.lit(MODE_MODEL))
        .otherwise(F.lit(MODE_RULE))
        .alias("router_mode"),
        hit.alias("cache_hit"),
    )


def fresh_routes(routed: DataFrame) -> DataFrame:
    """Cache rows for the texts that were not answered by the cache (one per hash)."""
    route = F.struct("selected_skills", "scores", "router_reason", "router_mode")
    return (
        routed.filter(~F.col("cache_hit"))
        .groupBy("doc_hash")
        .agg(F.first(route).alias("route"))
    )


# ---- chunks -------------------------------------------------------------------------------
def drifts(chunk_scores: Column, document_skills: Column, n_skills: int) -> Column:
    """True when a skill outside the document route clearly beats those inside."""
    inside = F.filter(chunk_scores, lambda s: F.array_contains(document_skills, s["skill"]))
    outside = F.filter(chunk_scores, lambda s: ~F.array_contains(document_skills, s["skill"]))
    best = lambda a: F.coalesce(
        F.array_max(F.transform(a, lambda s: s["score"])), F.lit(0.0)
    )
    return F.when(F.size(document_skills) >= n_skills, False).otherwise(
        let(
            F.struct(best(inside).alias("i"), best(outside).alias("o")),
            lambda b: (b["o"] >= REROUTE_MIN) & (b["o"] >= b["i"] + REROUTE_MARGIN),
        )
    )


def needs_chunk_reroute(
    df: DataFrame, n_skills: int, scores: str = "scores", document_skills: str = "document_skills"
) -> DataFrame:
    return df.withColumn("reroute", drifts(F.col(scores), F.col(document_skills), n_skills))


def route_chunks(
    chunks: DataFrame,
    skills: Sequence[Skill],
    cache: DataFrame | None = None,
    model_routes: DataFrame | None = None,
    text: str = "chunk_text",
) -> DataFrame:
    """Route chunk rows with ``document_skills`` and ``document_cache_hit``.

    Only drifting chunks are looked up again; the others reuse the document route. Without
    lookup tables this is one projection over the chunk rows. With them the scored rows,
    stripped of their text, are written once and only the drifting ones are joined.
    """
    scored = chunks.withColumn("scores", score_array(F.col(text), skills)).withColumn(
        "doc_hash", doc_hash(F.col(text))
    )
    judged = needs_chunk_reroute(scored, len(skills))
    reused = {
        "selected_skills": F.col("document_skills"),
        "router_reason": F.lit(REASON_REUSED),
        "router_mode": F.lit(MODE_REUSED),
        "cache_hit": F.col("document_cache_hit"),
    }
    if cache is None and model_routes is None:
        routed = route_documents(judged, skills)
        routed = routed.withColumns(
            {c: F.when(F.col("reroute"), F.col(c)).otherwise(v) for c, v in reused.items()}
        )
    else:
        narrow = stored(judged.drop(text))
        moved = route_documents(narrow.filter("reroute"), skills, cache, model_routes)
        routed = moved.unionByName(narrow.filter("not reroute").withColumns(reused))
    return routed.withColumnRenamed("selected_skills", "router_selected_skills").withColumns(
        {
            "selected_skills": F.slice(
                unique_values(F.col("router_selected_skills"), F.col("document_skills")), 1, MAX_SKILLS
            ),
            "routing_mode": F.when(F.col("reroute"), MODE_REROUTED).otherwise(MODE_REUSED),
        }
    )


def document_skill_total(routed_chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All skills of a document: its own route first, then chunk by chunk, first seen once.

    Reduced to one position per (document, skill) before anything is collected, so the
    final arrays are bounded by the registry size however many chunks a document has.
    """
    rows = routed_chunks.select(
        *keys,
        F.col("chunk_index").cast("long").alias("c"),
        posexplode(F.concat("document_skills", "selected_skills")).alias("p", "skill"),
        F.size("document_skills").alias("n"),
    )
    own_route = F.col("p") < F.col("n")
    position = F.struct(F.when(own_route, F.lit(-1)).otherwise(F.col("c")).alias("c"), "p")
    firsts = rows.groupBy(*keys, "skill").agg(F.min(position).alias("at"))
    return firsts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "skill"))), lambda s: s["skill"]).alias(
            "selected_skills"
        )
    )
