"""Tracing relations back to paragraphs, and document-level dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import inline, posexplode
from relmill.functions.text import compact, contains, key_part, let, null_if_empty, strip, text_of, unique_values

MATCH_TYPE = (
    "struct<section_id:string,page:int,global_block_id:int,bbox:array<double>,content:string>"
)
SOURCES = ("source_sections", "source_pages", "source_blocks", "source_paragraphs")


def searchable(sections: Column) -> Column:
    """Section array reduced to what matching reads, whitespace-free texts precomputed."""
    return F.transform(
        sections,
        lambda s: F.struct(
            s["section_id"].alias("section_id"),
            compact(s["text"]).alias("c"),
            F.transform(
                s["paragraphs"],
                lambda p: F.struct(p.alias("p"), compact(p["content"]).alias("c")),
            ).alias("ps"),
        ),
    )


def matches_of(head: Column, tail: Column, evidence: Column, sections: Column) -> Column:
    """Paragraphs that support a relation, in document order.

    Evidence in the paragraph; or head and tail in it; or evidence somewhere in the section
    and head or tail in the paragraph.
    """

    def search(q: Column) -> Column:
        def of_section(s: Column) -> Column:
            def of_paragraphs(cited: Column) -> Column:
                def fits(x: Column) -> Column:
                    content = x["p"]["content"]
                    has_head, has_tail = F.contains(content, q["h"]), F.contains(content, q["t"])
                    return (
                        contains(x["c"], q["e"])
                        | ((q["h"] != "") & (q["t"] != "") & has_head & has_tail)
                        | (cited & (has_head | has_tail))
                    )

                return F.transform(
                    F.filter(s["ps"], fits),
                    lambda x: F.struct(
                        s["section_id"].alias("section_id"),
                        x["p"]["page"].alias("page"),
                        x["p"]["global_block_id"].alias("global_block_id"),
                        x["p"]["bbox"].alias("bbox"),
                        x["p"]["content"].alias("content"),
                    ),
                )

            # a section is searched once, not once for each of its paragraphs
            return let(contains(s["c"], q["e"]), of_paragraphs)

        return F.flatten(F.transform(sections, of_section))

    return let(
        F.struct(strip(text_of(head)).alias("h"), strip(text_of(tail)).alias("t"), compact(text_of(evidence)).alias("e")), search
    )


def name_of(row: Column, fields: Sequence[str], first: str, other: str) -> Column:
    """A relation's name, under whichever of two field names it has one; empty if it has none."""
    given = [null_if_empty(text_of(row[f])) for f in (first, other) if f in fields]
    return F.coalesce(*given, F.lit(""))


def with_matches(
    batches: DataFrame, relations: str = "relations", keep: tuple[str, ...] = ("doc_id", "batch_index")
) -> DataFrame:
    """One row per relation of each batch row (``sections`` + relation array) with ``matches``.

    The relations of a batch come from the reply to that batch, so both sit in one row and
    no join on text is needed. They are matched there, as an array: what becomes rows is the
    relation with the paragraphs it matched, not the sections of the batch. A relation names
    its ends ``head`` and ``tail`` or ``subject`` and ``object``.
    """
    fields = batches.schema[relations].dataType.elementType.fieldNames()

    def matched(sections: Column) -> Column:
        return F.transform(
            F.array_compact(relations),
            lambda r: F.struct(
                r.alias("r"),
                matches_of(name_of(r, fields, "head", "subject"), name_of(r, fields, "tail", "object"), r["evidence"], sections).alias("m"),
            ),
        )

    prepared = batches.select(
        *keep,
        "section_ids",
        "block_ids",
        unique_values(
            F.flatten(F.transform("sections", lambda s: F.array(s["page_start"], s["page_end"])))
        ).alias("_pages"),
        let(searchable(F.col("sections")), matched).alias("_matched"),
    )
    rows = prepared.select(
        *keep, "section_ids", "block_ids", "_pages", posexplode("_matched").alias("relation_ord", "_r")
    )
    return rows.select(*keep, "relation_ord", "_r.r.*", F.col("_r.m").alias("matches"), "section_ids", "block_ids", "_pages")


def match_paragraphs(
    batches: DataFrame, relations: str = "relations", keep: tuple[str, ...] = ("doc_id", "batch_index")
) -> DataFrame:
    """Flat relation ↔ paragraph matches."""
    rows = with_matches(batches, relations, keep)
    return rows.select(*keep, "relation_ord", posexplode("matches").alias("match_ord", "m")).select(
        *keep, "relation_ord", "match_ord", "m.*"
    )


def attach_sources(
    batches: DataFrame, relations: str = "relations", keep: tuple[str, ...] = ("doc_id", "batch_index")
) -> DataFrame:
    """Relations with their source arrays; unmatched ones get the values of their batch.

    The fields of the relations stay as they are named.
    """
    rows = with_matches(batches, relations, keep)
    fields = batches.schema[relations].dataType.elementType.fieldNames()
    matched = F.size("matches") > 0

    def distinct_of(field: str) -> Column:
        return unique_values(F.transform("matches", lambda m: m[field]))

    return rows.select(
        *keep,
        "relation_ord",
        *fields,
        F.when(matched, distinct_of("section_id")).otherwise(F.col("section_ids")).alias(SOURCES[0]),
        F.when(matched, distinct_of("page")).otherwise(F.col("_pages")).alias(SOURCES[1]),
        F.when(matched, distinct_of("global_block_id")).otherwise(F.col("block_ids")).alias(SOURCES[2]),
        F.col("matches").alias(SOURCES[3]),
        F.col("batch_index").alias("source_batch_index"),
    )


def dedup_document(
    df: DataFrame,
    unit: Sequence[str] = ("doc_id",),
    order: Sequence[str] = ("source_batch_index", "relation_ord"),
) -> DataFrame:
    """One row per (head, predicate, tail, evidence), whitespace- and case-free.

    ``subject`` and ``object`` stand in for an empty or missing head and tail.

    The first row is kept and the four source arrays are united in first-seen order. Every
    array value is first reduced to its earliest position per key (map-side), so a key
    repeated millions of times collects no more than its distinct sources.
    """
    own_of = lambda first, other: F.coalesce(*[null_if_empty(text_of(F.col(c))) for c in (first, other) if c in df.columns], F.lit(""))
    parts = [own_of("head", "subject"), F.col("relation"), own_of("tail", "object"), F.col("evidence")]
    # the parts hold no whitespace, so a line break separates them; the digest keeps the
    # key short in both shuffles
    digest = F.unhex(F.sha2(F.concat_ws("\n", *[key_part(c) for c in parts]), 256))
    keys = ["_key"]
    keyed = df.withColumn("_key", digest)
    types = [df.schema[name].dataType for name in SOURCES]
    fields = [c for c in df.columns if c not in (*unit, *SOURCES)]

    def tag(number: int, name: str) -> Column:
        """Array values of one source column, typed into their own slot."""
        return F.transform(
            F.array_compact(name),
            lambda v, i: F.struct(
                F.lit(number).alias("kind"),
                i.alias("i"),
                *[
                    (v if m == number else F.lit(None).cast(t.elementType)).alias(f"v{m}")
                    for m, t in enumerate(types)
                ],
            ),
        )

    # kind -1 stands for the row itself: it travels once, without its arrays
    own = F.struct(
        F.lit(-1).alias("kind"),
        F.lit(0).alias("i"),
        *[F.lit(None).cast(t.elementType).alias(f"v{m}") for m, t in enumerate(types)],
    )
    tagged = F.concat(F.array(own), *[tag(m, name) for m, name in enumerate(SOURCES)])
    values = [f"v{m}" for m in range(len(SOURCES))]
    spread = keyed.select(
        *unit, *keys, F.struct(*order).alias("at"), F.struct(*fields).alias("row"), inline(tagged)
    ).withColumn("row", F.when(F.col("kind") == -1, F.col("row")))
    positions = spread.groupBy(*unit, *keys, "kind", *values).agg(
        F.min(F.struct("at", "i")).alias("pos"), F.min_by("row", "at").alias("row")
    )

    def united(m: int) -> Column:
        seen = F.collect_list(
            F.when(F.col("kind") == m, F.struct("pos", F.col(f"v{m}").alias("v")))
        )
        return F.transform(F.array_sort(seen), lambda x: x["v"])

    merged = positions.groupBy(*unit, *keys).agg(
        F.max(F.when(F.col("kind") == -1, F.col("row"))).alias("row"),
        *[united(m).alias(name) for m, name in enumerate(SOURCES)],
    )
    return merged.select(*unit, "row.*", *SOURCES)
