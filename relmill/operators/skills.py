"""Skill registry: validation, example parsing, change detection, upserts.

Registries are tables like any other; only :func:`registry_of` brings one to the driver,
after checking that it is small, so that scoring can be compiled into wide expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import posexplode
from relmill.functions.text import let, strip, text_of

# ---- fixed values -----------------------------------------------------------------------
REQUIRED_STRINGS = (
    "name",
    "description",
    "focus",
    "head_prior",
    "tail_prior",
    "relation_style",
    "negative_scope",
)
REQUIRED_LISTS = ("extraction_rules", "keywords", "fewshot")
SKILL_NAME = r"^[A-Za-z0-9_-]+\z"
# -----------------------------------------------------------------------------------------
RELATION_TYPE = "struct<head:string,relation:string,tail:string,evidence:string,skill:string>"
FEWSHOT_TYPE = "array<struct<text:string,json:string,is_document_level:boolean>>"
SKILL_SCHEMA = (
    ", ".join(f"{c} string" for c in REQUIRED_STRINGS)
    + f", extraction_rules array<string>, keywords array<string>, fewshot {FEWSHOT_TYPE}"
)


@dataclass(frozen=True)
class Example:
    text: str
    json: str
    is_document_level: bool = False


@dataclass(frozen=True)
class Skill:
    name: str
    keywords: tuple[str, ...] = ()
    description: str = ""
    focus: str = ""
    head_prior: str = ""
    tail_prior: str = ""
    relation_style: str = ""
    negative_scope: str = ""
    fewshot: tuple[Example, ...] = ()
    extraction_rules: tuple[str, ...] = field(default=())


def registry_of(skills: DataFrame) -> list[Skill]:
    """Bring a registry (with ``skill_ord``) to the driver.

    A registry is what people write by hand, a file a skill; it does not grow with the documents.
    """
    ordered = skills.orderBy("skill_ord")
    shaped = ordered.withColumn(
        "fewshot",
        F.transform(
            "fewshot",
            lambda e: e.withField("is_document_level", F.size(relations_of(e["json"])) > 1),
        ),
    )
    rows = shaped.collect()
    if not rows:
        raise ValueError("no skills found")
    return [
        Skill(
            **{c: r[c] or "" for c in REQUIRED_STRINGS},
            keywords=tuple(r["keywords"] or ()),
            extraction_rules=tuple(r["extraction_rules"] or ()),
            fewshot=tuple(
                Example(e["text"], e["json"], bool(e["is_document_level"]))
                for e in r["fewshot"] or ()
            ),
        )
        for r in rows
    ]


def relations_of(raw: Column) -> Column:
    """Relation array of a JSON text: a wrapped list, a bare list, or one object."""

    def pick(j: Column) -> Column:
        wrapped = F.from_json(j, f"struct<relation_list:array<{RELATION_TYPE}>>")["relation_list"]
        return (
            F.when(F.startswith(j, F.lit("[")), F.from_json(j, f"array<{RELATION_TYPE}>"))
            .when(F.get_json_object(j, "$.relation_list").isNotNull(), wrapped)
            .when(F.startswith(j, F.lit("{")), F.array(F.from_json(j, RELATION_TYPE)))
        )

    return F.coalesce(let(strip(text_of(raw)), pick), F.array().cast(f"array<{RELATION_TYPE}>"))


def _trimmed(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: strip(text_of(x))), lambda x: x != "")


def _example_error(item: Column, pos: Column) -> Column:
    label = F.concat(F.lit("fewshot["), (pos + 1).cast("string"), F.lit("]"))
    body = strip(text_of(item["json"]))
    parsed = F.try_parse_json(body)
    relations = F.try_variant_get(parsed, "$.relation_list", "array<variant>")
    return (
        F.when(item.isNull(), F.concat(label, F.lit(" must be an object")))
        .when(strip(text_of(item["text"])) == "", F.concat(label, F.lit(".text is required")))
        .when(body == "", F.concat(label, F.lit(".json is required")))
        .when(parsed.isNull(), F.concat(label, F.lit(".json must be valid JSON")))
        .when(relations.isNull(), F.concat(label, F.lit(".json must contain relation_list")))
    )


def validate_skills(df: DataFrame) -> DataFrame:
    """Normalise skill rows and add ``error``: the first failed check, null when valid."""
    checks = [
        (strip(text_of(F.col(c))) == "", F.lit(f"missing required field: {c}"))
        for c in REQUIRED_STRINGS
    ]
    checks.append((~F.rlike(strip(text_of(F.col("name"))), F.lit(SKILL_NAME)), F.lit("bad name")))
    checks += [(F.col(c).isNull(), F.lit(f"field must be a list: {c}")) for c in REQUIRED_LISTS]
    checks += [
        (F.size(_trimmed(F.col(c))) == 0, F.lit(f"field must not be empty: {c}"))
        for c in REQUIRED_LISTS[:2]
    ]
    example_errors = F.array_compact(F.transform("fewshot", _example_error))
    checks.append((F.size(example_errors) > 0, F.get(example_errors, F.lit(0))))
    checks.append((F.size("fewshot") == 0, F.lit("field must not be empty: fewshot")))
    error = F.lit(None).cast("string")
    for failed, message in reversed(checks):
        error = F.when(failed, message).otherwise(error)
    fewshot = F.transform(
        "fewshot",
        lambda e: F.struct(
            strip(text_of(e["text"])).alias("text"),
            strip(text_of(e["json"])).alias("json"),
            F.coalesce(e["is_document_level"], F.size(relations_of(e["json"])) > 1).alias(
                "is_document_level"
            ),
        ),
    )
    return df.withColumns(
        {
            "error": error,
            **{c: strip(text_of(F.col(c))) for c in REQUIRED_STRINGS},
            "extraction_rules": _trimmed(F.col("extraction_rules")),
            "keywords": _trimmed(F.col("keywords")),
            "fewshot": fewshot,
        }
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter(F.col("error").isNull()), validated.filter(F.col("error").isNotNull())


def fewshot_relations(df: DataFrame, keep: tuple[str, ...] = ("skill", "example_ord")) -> DataFrame:
    """One row per relation of each example (``json`` column)."""
    rows = df.select(*keep, posexplode(relations_of(F.col("json"))).alias("relation_ord", "r"))
    return rows.select(*keep, "relation_ord", "r.*")


def registry_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compare two snapshots ``(filename, modified, size)``: added, changed, removed."""
    joined = old.select(
        "filename", F.struct("modified", "size").alias("before")
    ).join(new.select("filename", F.struct("modified", "size").alias("after")), "filename", "full")
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "changed")
    )
    return joined.select("filename", change.alias("change")).filter("change is not null")


def upsert_skills(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply one change batch to a registry keyed by ``name``.

    ``changes`` holds the skill columns plus ``action`` (``create``/``update``) and
    ``target`` (the current name for updates). A batch holds one change per skill.
    Returns the new registry and the rejected changes with a ``reason``.
    """
    names = registry.select(F.col("name").alias("known"))
    looked = (
        changes.join(names, F.col("name") == F.col("known"), "left")
        .withColumn("name_taken", F.col("known").isNotNull())
        .drop("known")
        .join(names, F.col("target") == F.col("known"), "left")
        .withColumn("target_found", F.col("known").isNotNull())
        .drop("known")
    )
    create = F.col("action") == "create"
    moved = F.coalesce(F.col("target") != F.col("name"), F.lit(True))
    reason = (
        F.when(create & F.col("name_taken"), "conflict")
        .when(~create & ~F.col("target_found"), "not found")
        .when(~create & moved & F.col("name_taken"), "conflict")
    )
    judged = looked.withColumn("reason", reason).drop("name_taken", "target_found")
    accepted = judged.filter(F.col("reason").isNull())
    columns = registry.columns
    replaced = accepted.filter(F.col("action") == "update").select(F.col("target").alias("name"))
    kept = registry.join(replaced, "name", "left_anti").select(*columns)
    return kept.unionByName(accepted.select(*columns)), judged.filter(F.col("reason").isNotNull())
