"""Relation cleaning, grounding, evidence choice, exact dedup, confidence.

Relations are rows. A row that has to be checked against its text carries the *witness*
columns (``source``, ``source_compact``, ``source_units``, ``source_words``): they are computed once per unit
before the relations are exploded, used inside the same stage, and dropped before anything
is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import keep_where, posexplode
from relmill.functions.text import (
    compact,
    contains,
    let,
    non_empty,
    null_if_empty,
    shortest,
    strip,
    strip_edges,
    text_of,
)
from relmill.operators.text import evidence_array
from relmill.plans.store import stored

FIELDS = ("head", "relation", "tail", "evidence", "skill")
WITNESS = ("source", "source_compact", "source_units", "source_words")
# ---- fixed values -------------------------------------------------------------------------
VALID_DOUBLETS = ("人人", "看看", "想想", "谢谢", "往往", "常常", "刚刚", "仅仅", "稍稍")
WRONG_CORE = "防线"
BASE_CORE = "基地"
CORE_PREFIXES = ("基地", "前线", "作战")
UNIT_CHARS = "车营部队连团旅师群"
PREDICATE_SYNONYMS = {"受控制": "受控于", "接受": "接收", "位于于": "位于"}
PLACE_TOKENS = ("区", "桥", "岸", "高地", "坡", "站", "线", "口", "带", "地域")
SHORT_TASK_TAIL = 10
COMPRESSED_PREDICATES = (
    "任务", "失败于", "受限于", "不得", "不得攻击", "不攻击", "不得脱离", "优先转运", "准备抗击",
)
LONG_TAIL = 24
CONDITION_LEADS = (r"(?d)^.+?(?:后|前|时|情况下)，", r"(?d)^.+?(?:后|前|时|情况下)")
LEADING_VERBS = (
    "建立", "优先转运", "准备抗击", "压制", "封锁", "切断", "截获", "摧毁", "设置", "构设",
    "插入", "遮断射击", "重点压制", "不得",
)
GENERIC_HEADS = ("本次行动", "本阶段行动")
STOP_HEADS = ("主要目标", "次要目标", "失败条件", "时间约束", "优先原则")
STOP_PREDICATES = ("为", "由", "是")
STOP_GOAL_PREDICATES = ("主要目标", "次要目标", "失败条件")
SIDES = ("我方", "敌方")
SIDE_PREDICATES = ("实施", "拟实施", "目标为", "任务", "计划")
CLAUSE_MARKERS = (
    "并", "且", "以便", "用于", "确保", "随后", "同时", "若", "则", "必须", "任务", "行动",
)
BAD_TAIL_MARKERS = (
    "；", "。", "，且", "，并", "否则", "以防", "优先", "原则", "行动", "任务通报",
)
CLAUSE_LENGTH = 20
BAD_TAIL_LENGTH = 28
MAX_PREDICATE = 12
GENERIC_PREDICATES = (
    "必须", "关键", "威胁", "涉及", "包含", "属于", "有关", "关于", "实施", "进行", "执行",
    "开展", "推进", "推动", "促进", "加强", "提高", "提升", "增强", "完善", "优化", "改进", "改善",
)
PREDICATE_REPLACEMENTS = {
    "必须": "要求", "关键": "依赖", "威胁": "威胁到", "涉及": "相关", "包含": "组成",
}
SPLIT_PREDICATES = (
    "位于", "部署于", "集结于", "压制", "覆盖", "封锁", "切断", "依托", "连接", "保障",
)
SPLIT_SKILLS = ("force-organization", "engagement-effects")
TAIL_JOINERS = "、|以及|及|与|和"
MAX_PART = 24
KNOWN_PREDICATES = (
    "部署于", "集结于", "位于", "覆盖", "压制", "干扰", "封锁", "切断", "保障", "依托", "连接",
    "受控于", "节制", "指挥", "任务", "开始于", "结束于", "失败于", "受限于", "摧毁", "阻断",
    "遮断", "侦察",
)
# -------------------------------------------------------------------------------------------


def _any_of(c: Column, literals: Sequence[str]) -> Column:
    return F.rlike(c, F.lit("|".join(literals)))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c)


# ---- witness and rows ---------------------------------------------------------------------
def with_witness(units: DataFrame, text: str = "text") -> DataFrame:
    """Add the witness columns to a unit (document or chunk) row."""
    return units.withColumns(
        {
            "source": F.col(text),
            "source_compact": compact(F.col(text)),
            "source_units": F.transform(
                evidence_array(text_of(F.col(text))),
                lambda u: F.struct(u.alias("u"), compact(u).alias("c")),
            ),
            # each word once: names are looked for here, which is much shorter than a long text
            "source_words": F.array_join(F.array_distinct(F.split(F.col(text), "[ \n]+")), " "),
        }
    )


def without_witness(df: DataFrame) -> DataFrame:
    """The same columns with a null witness: nothing is grounded."""
    return df.withColumns(
        {
            "source": F.lit(None).cast("string"),
            "source_compact": F.lit(None).cast("string"),
            "source_units": F.lit(None).cast("array<struct<u:string,c:string>>"),
            "source_words": F.lit(None).cast("string"),
        }
    )


def explode_relations(
    units: DataFrame,
    relations: str = "relations",
    keep: tuple[str, ...] = ("doc_id",),
    ord_name: str = "relation_ord",
) -> DataFrame:
    """One row per relation object, its fields as plain strings."""
    rows = units.select(*keep, posexplode(relations).alias(ord_name, "_r")).filter(
        F.col("_r").isNotNull()
    )
    return rows.select(*keep, ord_name, *[text_of(F.col(f"_r.{f}")).alias(f) for f in FIELDS])


# ---- entity repair ------------------------------------------------------------------------
def _without_repeat(c: Column) -> Column:
    """Collapse the first doubled run of 2-5 characters, shortest run first; else null."""
    spared = "(?!" + "|".join(VALID_DOUBLETS) + ")"
    out = F.lit(None).cast("string")
    for size in (5, 4, 3, 2):
        lead = spared if size == 2 else ""
        pattern = rf"(?s)^(.*?)({lead}.{{{size}}})\2"
        out = F.when(F.rlike(c, F.lit(pattern)), F.regexp_replace(c, pattern, "$1$2")).otherwise(out)
    # most names have no doubled run at all: one test spares them the four searches
    return F.when(F.rlike(c, F.lit(r"(?s)(.{2,5})\1")), out)


def _held(doc: Column, words: Column | None, name: Column) -> Column:
    """``contains(doc, name)``, where ``words`` (if any) are the distinct words of ``doc`` between blanks.

    A name without blanks stands in the text if it stands in one of the words. Of one with
    blanks, the last piece must; only if it does, the text is searched.
    """
    if words is None:
        return contains(doc, name)
    piece = F.contains(words, F.substring_index(name, " ", -1))
    return (
        (doc != "") & (name != "")
        & F.when(F.contains(name, F.lit("\n")), F.contains(doc, name))
        .otherwise(piece & (~F.contains(name, F.lit(" ")) | F.contains(doc, name)))
    )


def repair_columns(
    df: DataFrame, column: str, source: str = "source", corpus_rules: bool = True, words: str | None = None
) -> DataFrame:
    """Repair one entity column against the source text of its row.

    ``words`` names the column with the distinct words of the text, as in the witness.
    """
    name, doc = F.col(column), text_of(F.col(source))
    known_words = None if words is None else F.col(words)
    held = lambda x: _held(doc, known_words, x)
    fixed = F.col("_fixed")
    work = df.withColumn("_fixed", F.when(F.char_length(name) >= 4, _without_repeat(name)))
    work = work.withColumn("_name", F.coalesce("_fixed", name))
    now = F.col("_name")
    size = F.char_length(now)
    found_fixed = fixed.isNotNull() & held(fixed)
    work = work.withColumn("_known", held(now))
    known = F.col("_known")
    # a doubled ending that the text itself contains is settled as it is
    settled = known & F.rlike(now, F.lit(r"(?s)(.{2,7})\1\z"))
    shorter = F.coalesce(
        *[
            F.when(
                (F.lit(cut) < F.least(F.lit(6), F.floor(size / 2)))
                & (size - cut >= 3)
                & held(now.substr(F.lit(1), size - cut)),
                now.substr(F.lit(1), size - cut),
            )
            for cut in range(1, 6)
        ]
    )
    # if even the shortest allowed prefix is not in the text, no longer one is
    deepest = F.least(F.lit(5), F.floor(size / 2) - 1, size - 3).cast("int")
    hopeful = (deepest >= 1) & held(now.substr(F.lit(1), size - deepest))
    shorter = F.when(~known & hopeful, shorter)
    result = F.coalesce(shorter, now)
    if corpus_rules:
        result = F.coalesce(shorter, F.when(doc != "", _corpus_substitution(now, doc)), now)
    final = (
        F.when(F.char_length(name) < 4, name)
        .when(found_fixed, fixed)
        .when(settled, now)
        .otherwise(result)
    )
    return work.withColumn(column, final).drop("_fixed", "_name", "_known")


def _corpus_substitution(name: Column, doc: Column) -> Column:
    """Known wrong core word: swap it for the core the text uses."""
    ending = F.regexp_extract(name, rf"(?s)([{UNIT_CHARS}][^{UNIT_CHARS}]*)\z", 1)
    unit = F.concat(F.lit(BASE_CORE), ending)
    rest = F.regexp_extract(name, rf"(?s){WRONG_CORE}(.*)\z", 1)
    swaps = []
    for prefix in CORE_PREFIXES:
        candidate = F.concat(F.lit(prefix), rest)
        fits = contains(doc, candidate) | (
            (F.char_length(candidate) < F.char_length(name)) & (F.char_length(candidate) >= 3)
        )
        swaps.append(F.when(fits, candidate))
    return F.when(
        F.contains(name, F.lit(WRONG_CORE)),
        F.coalesce(
            F.when(
                F.contains(doc, F.lit(BASE_CORE)) & (ending != "") & F.contains(doc, unit), unit
            ),
            *swaps,
        ),
    )


def repair_entities(df: DataFrame, corpus_rules: bool = True) -> DataFrame:
    words = "source_words" if "source_words" in df.columns else None
    for column in ("head", "tail"):
        df = repair_columns(df, column, corpus_rules=corpus_rules, words=words)
    return df


# ---- predicates and tails -----------------------------------------------------------------
# These steps are columns on columns rather than nested lambdas: a lambda takes its whole
# projection out of code generation, and the rows here still carry their source text.
def normalize_predicates(df: DataFrame) -> DataFrame:
    """Synonyms first, then the two predicates that depend on the tail."""
    r, tail = F.col("relation"), F.col("tail")
    return df.withColumn("relation", _mapped(strip(r), PREDICATE_SYNONYMS)).withColumn(
        "relation",
        F.when((r == "部署") & _any_of(tail, PLACE_TOKENS), "部署于")
        .when((r == "负责") & (F.char_length(tail) <= SHORT_TASK_TAIL), "任务")
        .otherwise(r),
    )


def compress_tails(df: DataFrame) -> DataFrame:
    """Condition clause off, the shortest clause of a long tail, leading verb off."""
    c = F.col("_tail")

    def behind(pattern: str) -> Column:
        rest = F.when(F.rlike(c, F.lit(pattern)), strip_edges(F.regexp_replace(c, pattern, "")))
        return null_if_empty(rest)

    clause = shortest(non_empty(F.transform(F.split(c, "[；。]"), strip_edges)))
    shorter = F.when(
        (F.char_length(c) > LONG_TAIL) & (F.char_length(clause) < F.char_length(c)), clause
    )
    verbs = rf"(?d)^(?:{'|'.join(LEADING_VERBS)})(.+)$"
    fires = F.col("relation").isin(*COMPRESSED_PREDICATES)
    return (
        df.withColumn("_tail", F.when(fires, strip_edges(F.col("tail"))))
        .withColumn("_tail", F.coalesce(*[behind(p) for p in CONDITION_LEADS], c))
        .withColumn("_tail", F.coalesce(shorter, c))
        .withColumn(
            "tail",
            F.coalesce(null_if_empty(strip_edges(F.regexp_extract(c, verbs, 1))), c, F.col("tail")),
        )
        .drop("_tail")
    )


# ---- grounding ------------------------------------------------------------------------------
def _supporting_unit(head: Column, tail: Column, units: Column) -> Column:
    """Shortest unit with head and tail (generic heads: with the tail); null when none."""

    def search(b: Column) -> Column:
        best = lambda xs: shortest(F.transform(xs, lambda x: x["u"]))
        both = F.filter(units, lambda x: F.contains(x["c"], b["t"]) & F.contains(x["c"], b["h"]))
        tails = F.filter(units, lambda x: F.contains(x["c"], b["t"]))
        return F.when(
            b["t"] != "",
            F.coalesce(
                F.when(b["h"] != "", best(both)), F.when(head.isin(*GENERIC_HEADS), best(tails))
            ),
        )

    return let(F.struct(compact(head).alias("h"), compact(tail).alias("t")), search)


def with_support(df: DataFrame, cited_too: bool = False) -> DataFrame:
    """Columns ``_cited`` (evidence is in the source) and ``_unit`` (supporting unit).

    A cited row is grounded without a unit, so its unit is null unless ``cited_too``.
    """
    unit = _supporting_unit(F.col("head"), F.col("tail"), F.col("source_units"))
    told = df.withColumn("_cited", contains(F.col("source_compact"), compact(F.col("evidence"))))
    return told.withColumn("_unit", unit if cited_too else F.when(~F.coalesce(F.col("_cited"), F.lit(False)), unit))


def is_grounded() -> Column:
    return F.col("source").isNull() | F.col("_cited") | F.col("_unit").isNotNull()


def with_evidence(df: DataFrame, where: Column | None = None) -> DataFrame:
    """The shortest of the given evidence, the supporting unit and the joined fields that the source holds.

    Takes the columns of :func:`with_support` (``cited_too``) away. Rows outside ``where`` keep their evidence.
    """
    free = F.col("source").isNull()
    given, joined = strip(F.col("evidence")), strip(F.concat("head", "relation", "tail"))
    size = lambda c: F.coalesce(F.char_length(c), F.lit(2**31 - 1))
    # columns of their own, as they are read more than once; the joined fields are looked for in
    # the source only if they would be the shortest
    work = df.withColumns({"_given": F.when((given != "") & (free | F.col("_cited")), given), "_joined": joined})
    unit = F.when(~free, F.col("_unit"))
    shortest_ = (
        (F.col("_joined") != "")
        & (F.char_length("_joined") < F.least(size(F.col("_given")), size(unit)))
        & (free | contains(F.col("source_compact"), compact(F.col("_joined"))))
    )
    best = F.when(shortest_, F.col("_joined")).when(size(F.col("_given")) <= size(unit), F.col("_given")).otherwise(unit)
    best = F.coalesce(best, F.lit(""))
    if where is not None:
        best = F.when(where, best).otherwise(F.col("evidence"))
    return work.withColumn("evidence", best).drop("_cited", "_unit", "_given", "_joined")


def ground_relations(df: DataFrame) -> DataFrame:
    """Keep relations that their witness supports; a null witness keeps everything."""
    return keep_where(with_support(df), is_grounded()).drop("_cited", "_unit")


def select_evidence(df: DataFrame) -> DataFrame:
    return with_evidence(with_support(df, cited_too=True))


# ---- sanitising -----------------------------------------------------------------------------
def drop_reason(skills: Sequence[str] | None) -> Column:
    """First rule a cleaned relation breaks; null when it passes (grounding excluded)."""
    head, relation, tail, skill = (F.col(c) for c in ("head", "relation", "tail", "skill"))
    replaceable = tuple(PREDICATE_REPLACEMENTS)
    rules = [
        ((head == "") | (relation == "") | (tail == "") | (skill == ""), "blank field"),
        (F.char_length(relation) > MAX_PREDICATE, "long predicate"),
        (head.isin(*STOP_HEADS), "stop head"),
        (relation.isin(*STOP_PREDICATES), "stop predicate"),
        (
            (F.char_length(head) > CLAUSE_LENGTH)
            & _any_of(head, CLAUSE_MARKERS)
            & ~head.isin(*GENERIC_HEADS),
            "clause head",
        ),
        ((F.char_length(tail) > BAD_TAIL_LENGTH) & _any_of(tail, BAD_TAIL_MARKERS), "clause tail"),
        (head.isin(*SIDES) & relation.isin(*SIDE_PREDICATES), "generic side"),
        (relation.isin(*STOP_GOAL_PREDICATES), "goal predicate"),
        (relation.isin(*GENERIC_PREDICATES) & ~relation.isin(*replaceable), "generic predicate"),
    ]
    if skills is not None:
        rules.append((~skill.isin(*skills), "unknown skill"))
    reason = F.lit(None).cast("string")
    for broken, label in reversed(rules):
        reason = F.when(broken, label).otherwise(reason)
    return reason


def clean_fields(df: DataFrame, corpus_rules: bool = True) -> DataFrame:
    """Trim, repair entities, normalise predicates before and after tail compression."""
    trimmed = df.withColumns(
        {
            **{c: strip_edges(F.col(c)) for c in ("head", "relation", "tail")},
            "evidence": strip(F.col("evidence")),
            "skill": strip(F.col("skill")),
        }
    )
    repaired = repair_entities(trimmed, corpus_rules)
    return normalize_predicates(compress_tails(normalize_predicates(repaired)))


def judge_relations(
    df: DataFrame, skills: Sequence[str] | None = None, corpus_rules: bool = True, choose: bool = True
) -> DataFrame:
    """Cleaned relations with ``reason``: why a row is dropped, null when it is kept.

    Rows that fail a cheap rule skip the search in the source. Kept rows get their evidence
    if ``choose``.
    """
    judged = clean_fields(df, corpus_rules).withColumn("reason", drop_reason(skills))
    judged = judged.withColumn(
        "relation",
        F.when(F.col("reason").isNull(), _mapped(F.col("relation"), PREDICATE_REPLACEMENTS))
        .otherwise(F.col("relation")),
    )
    passed = F.col("reason").isNull()
    supported = with_support(
        judged.withColumn("source_units", F.when(passed, F.col("source_units"))), cited_too=choose
    )
    grounded = supported.withColumn(
        "reason", F.when(passed & ~F.coalesce(is_grounded(), F.lit(False)), "not grounded")
        .otherwise(F.col("reason"))
    )
    chosen = with_evidence(grounded, F.col("reason").isNull()) if choose else grounded.drop("_cited", "_unit")
    return chosen.drop(*WITNESS)


def sanitize_relations(
    df: DataFrame, skills: Sequence[str] | None = None, corpus_rules: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Kept relations and dropped ones (with ``reason``)."""
    # two plans; only kept rows have their evidence chosen
    kept, dropped = (judge_relations(df, skills, corpus_rules, choose) for choose in (True, False))
    return (
        keep_where(kept, F.col("reason").isNull()).drop("reason"),
        keep_where(dropped, F.col("reason").isNotNull()),
    )


def expand_compound_tails(
    df: DataFrame, skills: Sequence[str] = SPLIT_SKILLS, part_name: str = "part_ord"
) -> DataFrame:
    """Split enumerated tails whose parts (two or more) all stand in the evidence."""
    parts = non_empty(F.transform(F.split(strip_edges(F.col("tail")), TAIL_JOINERS), strip_edges))
    usable = F.when(
        (F.size(parts) >= 2) & ~F.exists(parts, lambda p: F.char_length(p) > MAX_PART),
        F.filter(parts, lambda p: F.contains(F.col("evidence"), p)),
    )
    fires = F.col("relation").isin(*SPLIT_PREDICATES) & F.col("skill").isin(*skills)
    tails = let(
        F.when(fires, usable),
        lambda u: F.when(F.size(u) >= 2, u).otherwise(F.array(F.col("tail"))),
    )
    others = [c for c in df.columns if c != "tail"]
    rows = df.select(*others, posexplode(tails).alias(part_name, "tail"))
    return rows.select(*df.columns, part_name)


# ---- exact dedup ------------------------------------------------------------------------------
def with_keys(df: DataFrame) -> DataFrame:
    """Whitespace-free key columns; rows without head, predicate or tail disappear."""
    keyed = df.withColumns(
        {f"_{f}": compact(F.col(f)) for f in ("head", "relation", "tail", "skill")}
    )
    named = (F.col("_head") != "") & (F.col("_relation") != "") & (F.col("_tail") != "")
    return keep_where(keyed, named)


def dedup_exact(
    df: DataFrame, unit: Sequence[str] = ("doc_id",), order: Sequence[str] = ("relation_ord",)
) -> DataFrame:
    """First row per (unit, head, predicate, tail, skill) with the shortest evidence.

    Pure aggregates, so duplicates collapse map-side before the shuffle.
    """
    evidence = strip(F.col("evidence"))
    at = F.struct(*order)
    keys = ("_head", "_relation", "_tail", "_skill")
    best = F.min(
        F.when(
            evidence != "",
            F.struct(
                F.char_length(evidence).alias("n"), at.alias("at"), evidence.alias("evidence")
            ),
        )
    )
    first = F.min(F.struct(at.alias("at"), F.struct("head", "relation", "tail", "skill").alias("r")))
    grouped = with_keys(df).groupBy(*unit, *keys).agg(first.alias("_first"), best.alias("_best"))
    return grouped.select(
        *unit,
        *[F.col(f"_first.at.{o}").alias(o) for o in order],
        "_first.r.head",
        "_first.r.relation",
        "_first.r.tail",
        F.coalesce("_best.evidence", F.lit("")).alias("evidence"),
        "_first.r.skill",
    )


# ---- confidence ---------------------------------------------------------------------------------
def confidence_points(source_compact: Column) -> Column:
    """Score in hundredths."""
    head, relation, tail, evidence = (F.col(c) for c in ("head", "relation", "tail", "evidence"))
    n_ev, n_head, n_tail = (F.char_length(c) for c in (evidence, head, tail))
    has_head, has_tail = F.contains(evidence, head), F.contains(evidence, tail)
    given = evidence != ""
    points = F.when(n_ev.between(4, 120), 25).when(given, 10).otherwise(0)
    points += F.when(given & has_head & has_tail, 30).when(given & (has_head | has_tail), 10).otherwise(0)
    points += F.when(relation.isin(*KNOWN_PREDICATES), 20).otherwise(0)
    points += (
        F.when(n_head.between(1, 16) & n_tail.between(1, 20), 15)
        .when((n_head <= 20) & (n_tail <= 24), 5)
        .otherwise(0)
    )
    points += F.when(F.coalesce(contains(source_compact, compact(evidence)), F.lit(False)), 10).otherwise(0)
    return F.least(points, F.lit(100))


def score_confidence(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", confidence_points(F.col("source_compact")) / 100)


def split_by_confidence(df: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Rows of at least ``threshold`` and the others, without the witness.

    The scored rows are written once: both tables read them, and neither scores again.
    """
    scored = df if "confidence" in df.columns else score_confidence(df)
    scored = stored(scored.drop(*WITNESS))
    high = F.col("confidence") >= threshold
    return scored.where(high), scored.where(~high)
