"""Relation batches of one document: grouping, token guard, indexing.

A batch list is an ``ARRAY<STRUCT>`` derived from the section list of the same row, so
sections → batches → guarded batches is one projection without any shuffle; the rows
appear when :func:`index_batches` explodes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.config import SplitConfig
from relmill.functions.rows import posexplode
from relmill.functions.text import (
    estimate_tokens,
    let,
    null_if_empty,
    runs,
    strip,
    text_of,
    unique_values,
)
from relmill.operators.sections import SECTION_TYPE, markdown_paragraph
from relmill.operators.text import hard_cut_array

BATCH_TYPE = (
    "struct<split_mode:string,section_ids:array<string>,parent_title:string,page_start:int,"
    f"page_end:int,block_ids:array<int>,text:string,sections:array<{SECTION_TYPE}>,"
    "hard_split_index:int>"
)
PUBLIC_COLUMNS = (
    "batch_index",
    "split_mode",
    "section_ids",
    "parent_title",
    "page_start",
    "page_end",
    "block_ids",
    "estimated_tokens",
    "text",
)


def batch_struct(
    sections: Column,
    mode: str,
    text: Column | None = None,
    parent_title: Column | None = None,
    hard_split_index: Column | None = None,
) -> Column:
    """One batch over a section array; a ``text`` that is given must be stripped."""

    def build(ss: Column) -> Column:
        joined = F.array_join(
            F.filter(F.transform(ss, lambda s: strip(s["text"])), lambda t: t != ""), "\n\n"
        )
        parents = unique_values(F.transform(ss, lambda s: null_if_empty(strip(s["parent_title"]))))
        common = let(
            parents, lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(F.lit(""))
        )
        return F.struct(
            F.lit(mode).alias("split_mode"),
            F.transform(ss, lambda s: s["section_id"]).alias("section_ids"),
            (common if parent_title is None else parent_title).alias("parent_title"),
            F.coalesce(F.array_min(F.transform(ss, lambda s: s["page_start"])), F.lit(1)).alias(
                "page_start"
            ),
            F.coalesce(F.array_max(F.transform(ss, lambda s: s["page_end"])), F.lit(1)).alias(
                "page_end"
            ),
            F.flatten(F.transform(ss, lambda s: s["block_ids"])).alias("block_ids"),
            (strip(joined) if text is None else text).alias("text"),
            ss.alias("sections"),
            (F.lit(None) if hard_split_index is None else hard_split_index)
            .cast("int")
            .alias("hard_split_index"),
        )

    return let(sections, build)


def _with_text(batches: Column) -> Column:
    return F.filter(batches, lambda b: b["text"] != "")


def fixed_batches(sections: Column, size: int, mode: str) -> Column:
    """Every ``size`` consecutive sections."""
    if size == 1:
        return _with_text(F.transform(sections, lambda s: batch_struct(F.array(s), mode, strip(text_of(s["text"])))))
    offsets = F.filter(
        F.transform(sections, lambda s, i: i), lambda i: i % F.lit(size) == 0
    )
    return _with_text(
        F.transform(offsets, lambda i: batch_struct(F.slice(sections, i + 1, F.lit(size)), mode))
    )


def chapter_batches(sections: Column) -> Column:
    """Consecutive sections that share a parent (or, without one, their own id)."""

    def chapter_of(s: Column) -> Column:
        parent = strip(s["parent_title"])
        own = parent == ""
        return F.struct(
            own.alias("own"), F.when(own, s["section_id"]).otherwise(parent).alias("key")
        )

    def group(b: Column) -> Column:
        starts = F.array_compact(
            F.transform(
                b["keys"],
                lambda k, i: F.when(
                    (i == 0) | ~k.eqNullSafe(F.get(b["keys"], i - 1)), i
                ),
            )
        )
        return F.transform(
            runs(starts, F.size(b["keys"])),
            lambda r: let(
                F.slice(b["ss"], r["lo"] + 1, r["n"]),
                # the title of a group is that of its last section
                lambda part: let(
                    F.element_at(part, -1),
                    lambda last: batch_struct(
                        part,
                        "chapter",
                        parent_title=F.coalesce(
                            null_if_empty(strip(last["parent_title"])), strip(last["title"])
                        ),
                    ),
                ),
            ),
        )

    pair = F.struct(sections.alias("ss"), F.transform(sections, chapter_of).alias("keys"))
    return _with_text(F.when(F.size(sections) > 0, let(pair, group)).otherwise(
        F.array().cast(f"array<{BATCH_TYPE}>")
    ))


def _with_paragraphs(section: Column, paragraphs: Column, text: Column) -> Column:
    """The section narrowed to some of its paragraphs."""

    def build(ps: Column) -> Column:
        pages = F.array_compact(F.transform(ps, lambda p: p["page"]))
        return F.struct(
            section["section_id"].alias("section_id"),
            section["title"].alias("title"),
            section["parent_title"].alias("parent_title"),
            F.coalesce(F.array_min(pages), section["page_start"]).alias("page_start"),
            F.coalesce(F.array_max(pages), section["page_end"]).alias("page_end"),
            F.array_compact(F.transform(ps, lambda p: p["global_block_id"])).alias("block_ids"),
            text.alias("text"),
            ps.alias("paragraphs"),
        )

    return let(paragraphs, build)


def _first_occurrences(paragraphs: Column) -> Column:
    """Drop repeats of (content, page, block), keeping the first paragraph of each; of structs of ``c``, the stripped content, and ``p``."""
    marker = lambda x: F.struct(
        x["c"].alias("c"), x["p"]["page"].alias("p"), x["p"]["global_block_id"].alias("b")
    )
    return let(
        F.transform(paragraphs, marker),
        lambda ms: F.filter(
            paragraphs, lambda x, i: F.array_position(ms, marker(x)) == (i + 1)
        ),
    )


def section_paragraph_batches(section: Column) -> Column:
    """One batch per body paragraph, each led by the section's title paragraphs.

    Every content is stripped once and kept beside its paragraph.
    """

    def build(sec: Column) -> Column:
        stripped = F.transform(sec["paragraphs"], lambda p: F.struct(strip(p["content"]).alias("c"), p.alias("p")))

        def split(b: Column) -> Column:
            is_title = lambda x: F.array_contains(b["titles"], x["c"])
            return let(
                F.struct(F.filter(b["all"], is_title).alias("context"), F.filter(b["all"], lambda x: ~is_title(x)).alias("body")),
                emit,
            )

        def emit(b: Column) -> Column:
            has_body = F.size(b["body"]) > 0
            lead = F.when(has_body, b["context"]).otherwise(F.slice(b["context"], 1, 0))
            rows = F.when(has_body, b["body"]).otherwise(b["context"])
            return let(lead, lambda first: F.transform(rows, lambda x: batch(first, x)))

        def batch(lead: Column, x: Column) -> Column:
            led = F.when(F.size(lead) > 0, _first_occurrences(F.concat(lead, F.array(x)))).otherwise(F.array(x))
            return let(
                led,
                lambda xs: let(
                    F.array_join(F.transform(xs, lambda y: y["c"]), "\n\n"),
                    lambda t: batch_struct(
                        F.array(_with_paragraphs(sec, F.transform(xs, lambda y: y["p"]), t)),
                        "paragraph",
                        text=t,
                        parent_title=sec["parent_title"],
                    ),
                ),
            )

        titles = F.array(strip(sec["title"]), strip(sec["parent_title"]))
        return let(F.struct(titles.alias("titles"), F.filter(stripped, lambda x: x["c"] != "").alias("all")), split)

    return _with_text(let(section, build))


def _cut_batch(batch: Column, max_tokens: int) -> Column:
    """Hard-split pieces of an over-budget batch; they come stripped."""

    def piece(text: Column, i: Column) -> Column:
        def one(sec: Column) -> Column:
            lead = F.coalesce(F.get(sec["paragraphs"], F.lit(0)), markdown_paragraph(text))
            narrowed = _with_paragraphs(sec, F.array(lead.withField("content", text)), text)
            return batch_struct(
                F.array(narrowed),
                "hard_split",
                text=text,
                parent_title=batch["parent_title"],
                hard_split_index=i,
            )

        whole = F.struct(
            F.lit("hard_split").alias("split_mode"),
            *[
                batch[f].alias(f)
                for f in ("section_ids", "parent_title", "page_start", "page_end", "block_ids")
            ],
            text.alias("text"),
            batch["sections"].alias("sections"),
            i.cast("int").alias("hard_split_index"),
        )
        return F.when(
            F.size(batch["sections"]) == 1, one(F.get(batch["sections"], F.lit(0)))
        ).otherwise(whole)

    return F.transform(hard_cut_array(batch["text"], max_tokens), piece)


def guard_array(batches: Column, mode: str, max_tokens: int) -> Column:
    """Replace over-budget batches level by level: section, paragraph, hard cut."""

    def fits(b: Column) -> Column:
        return estimate_tokens(b["text"]) <= max_tokens

    def refine(b: Column, expand) -> Column:
        return let(b, lambda x: F.when(fits(x), F.array(x)).otherwise(expand(x)))

    def cut(b: Column) -> Column:
        return refine(b, lambda x: _cut_batch(x, max_tokens))

    def by_paragraph(b: Column) -> Column:
        paragraphs = F.flatten(F.transform(b["sections"], section_paragraph_batches))
        return F.flatten(F.transform(paragraphs, cut))

    def by_section(b: Column) -> Column:
        small = fixed_batches(b["sections"], 1, "small_section")
        return F.flatten(F.transform(small, lambda x: refine(x, by_paragraph)))

    def top(b: Column) -> Column:
        if mode == "chapter":
            return refine(b, by_section)
        if mode == "fixed_sections":
            return refine(
                b,
                lambda x: F.when(F.size(x["sections"]) > 1, by_section(x)).otherwise(
                    by_paragraph(x)
                ),
            )
        if mode == "small_section":
            return refine(b, by_paragraph)
        return cut(b)

    return F.flatten(F.transform(batches, top))


def batch_array(sections: Column, mode: str, size: int = 1) -> Column:
    if mode == "chapter":
        return let(sections, chapter_batches)
    if mode == "paragraph":
        return F.flatten(F.transform(sections, section_paragraph_batches))
    if mode == "fixed_sections":
        return let(sections, lambda s: fixed_batches(s, size, mode))
    return let(sections, lambda s: fixed_batches(s, 1, "small_section"))


def whole_document_batch(text: Column, mode: str) -> Column:
    return F.struct(
        F.lit(mode).alias("split_mode"),
        F.array(F.lit("document")).alias("section_ids"),
        F.lit("").alias("parent_title"),
        F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"),
        F.array().cast("array<int>").alias("block_ids"),
        strip(text).alias("text"),
        F.array().cast(f"array<{SECTION_TYPE}>").alias("sections"),
        F.lit(None).cast("int").alias("hard_split_index"),
    )


# ---- operators ----------------------------------------------------------------------------
def batch_small_sections(df: DataFrame) -> DataFrame:
    return df.withColumn("batches", batch_array(F.col("sections"), "small_section"))


def batch_fixed_sections(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("batches", batch_array(F.col("sections"), "fixed_sections", size))


def batch_chapters(df: DataFrame) -> DataFrame:
    return df.withColumn("batches", batch_array(F.col("sections"), "chapter"))


def batch_paragraphs(df: DataFrame) -> DataFrame:
    return df.withColumn("batches", batch_array(F.col("sections"), "paragraph"))


def make_batch(df: DataFrame, mode: str = "fixed_sections") -> DataFrame:
    """All sections of the row as one batch."""
    return df.withColumn("batches", F.array(batch_struct(F.col("sections"), mode)))


def guard_tokens(df: DataFrame, mode: str, max_tokens: int) -> DataFrame:
    return df.withColumn("batches", guard_array(F.col("batches"), mode, max_tokens))


def document_batch(df: DataFrame, mode: str, max_tokens: int, text: str = "text") -> DataFrame:
    """Documents without any section batch fall back to their whole text."""
    whole = whole_document_batch(F.col(text), mode)
    fallback = F.flatten(
        F.transform(
            F.array(whole),
            lambda b: F.when(estimate_tokens(b["text"]) <= max_tokens, F.array(b)).otherwise(
                _cut_batch(b, max_tokens)
            ),
        )
    )
    return df.withColumn(
        "batches", F.when(F.size("batches") > 0, F.col("batches")).otherwise(fallback)
    )


def index_batches(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Explode to rows, dropping empty texts, with a dense 0-based index per document."""
    live = F.filter(F.col("batches"), lambda b: strip(b["text"]) != "")
    rows = df.select(*keep, posexplode(live).alias("batch_index", "b"))
    return rows.select(*keep, "batch_index", "b.*").withColumn(
        "estimated_tokens", estimate_tokens(F.col("text"))
    )


def public_batch(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return df.select(*keep, *PUBLIC_COLUMNS)


def build_batches(
    df: DataFrame,
    config: SplitConfig,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Sections → batches → token guard → fallback → rows, for documents with ``sections``."""
    batches = guard_array(
        batch_array(F.col("sections"), config.split_mode, config.batch_size),
        config.split_mode,
        config.max_batch_tokens,
    )
    guarded = df.withColumn("batches", batches)
    filled = document_batch(guarded, config.split_mode, config.max_batch_tokens, text)
    return index_batches(filled, keep)
