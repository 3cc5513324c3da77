"""Sections of one markdown document (titles, parents, ids).

A section list lives inside its document row as ``ARRAY<STRUCT>``: the whole step is a
projection, and :func:`section_rows` explodes it where a flat table is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.text import WS, let, null_if_empty, strip
from relmill.operators.text import explode_pieces, paragraph_array

# ---- fixed values: title patterns -------------------------------------------------------
NUMBERED_ID = r"^(\p{Nd}+(?:[.．]\p{Nd}+)+)"
# the id, optional blanks, then at most one line of title text
NUMBERED_TITLE = NUMBERED_ID + WS + r"*[^\n]*\z"
CHINESE_TITLE = r"^([一二三四五六七八九十百千万]+)、"
DOC_TITLE_OPEN = "《"
DOC_TITLE_CLOSE = "》"
DOC_TITLE_MAX = 80
# -----------------------------------------------------------------------------------------

PARAGRAPH_TYPE = (
    "struct<page:int,label:string,content:string,bbox:array<double>,global_block_id:int>"
)
SECTION_TYPE = (
    "struct<section_id:string,title:string,parent_title:string,page_start:int,page_end:int,"
    f"block_ids:array<int>,text:string,paragraphs:array<{PARAGRAPH_TYPE}>>"
)


def is_numbered(c: Column) -> Column:
    return F.rlike(c, F.lit(NUMBERED_TITLE))


def is_chinese(c: Column) -> Column:
    return F.rlike(c, F.lit(CHINESE_TITLE))


def is_doc_title(c: Column) -> Column:
    return (
        F.startswith(c, F.lit(DOC_TITLE_OPEN))
        & F.contains(c, F.lit(DOC_TITLE_CLOSE))
        & (F.char_length(c) <= DOC_TITLE_MAX)
    )


def title_kind(c: Column) -> Column:
    """``N`` numbered, ``C`` chinese, ``D`` document title, null for body text."""
    return (
        F.when(is_numbered(c), "N").when(is_chinese(c), "C").when(is_doc_title(c), "D")
    )


def section_id_of(title: Column, ordinal: Column) -> Column:
    return F.coalesce(
        F.when(
            is_numbered(title),
            F.replace(F.regexp_extract(title, NUMBERED_ID, 1), F.lit("．"), F.lit(".")),
        ),
        null_if_empty(F.regexp_extract(title, CHINESE_TITLE, 1)),
        F.when(
            F.startswith(title, F.lit(DOC_TITLE_OPEN)) & F.contains(title, F.lit(DOC_TITLE_CLOSE)),
            F.lit("doc-title"),
        ),
        F.concat(F.lit("section-"), F.lpad(ordinal.cast("string"), 3, "0")),
    )


def markdown_paragraph(content: Column) -> Column:
    return F.struct(
        F.lit(None).cast("int").alias("page"),
        F.lit("markdown").alias("label"),
        strip(content).alias("content"),
        F.lit(None).cast("array<double>").alias("bbox"),
        F.lit(None).cast("int").alias("global_block_id"),
    )


def section_struct(
    section_id: Column, title: Column, parent_title: Column, paragraphs: Column
) -> Column:
    """Assemble a section from its paragraphs; pages default to 1 when unknown."""

    def build(ps: Column) -> Column:
        pages = F.transform(ps, lambda p: F.coalesce(p["page"], F.lit(1)))
        return F.struct(
            section_id.alias("section_id"),
            title.alias("title"),
            parent_title.alias("parent_title"),
            F.coalesce(F.array_min(pages), F.lit(1)).alias("page_start"),
            F.coalesce(F.array_max(pages), F.lit(1)).alias("page_end"),
            F.array_compact(F.transform(ps, lambda p: p["global_block_id"])).alias("block_ids"),
            strip(F.array_join(F.transform(ps, lambda p: strip(p["content"])), "\n\n")).alias("text"),
            ps.alias("paragraphs"),
        )

    return let(F.filter(paragraphs, lambda p: p["content"] != ""), build)


def _openings(kinds: Column) -> Column:
    """Boundary positions with their parent position, parents themselves left out.

    Only title positions are walked. The running value is the position of the parent in
    force: a chinese title directly followed by a numbered one sets it, any other
    non-numbered title clears it.
    """
    marks = F.filter(
        F.transform(
            kinds,
            lambda k, i: F.struct(
                i.alias("i"),
                k.alias("kind"),
                ((k == "C") & F.coalesce(F.get(kinds, i + 1) == "N", F.lit(False))).alias("parent"),
            ),
        ),
        lambda m: m["kind"].isNotNull() | (m["i"] == 0),
    )
    start = F.struct(
        F.lit(-1).alias("parent"),
        F.array().cast("array<struct<lo:int,parent:int,skip:boolean>>").alias("out"),
    )

    def step(acc: Column, m: Column) -> Column:
        is_parent = F.coalesce(m["parent"], F.lit(False))
        inherited = F.when(m["kind"] == "N", acc["parent"]).otherwise(F.lit(-1))
        return F.struct(
            F.when(is_parent, m["i"])
            .when(m["kind"].isNull() | (m["kind"] == "N"), acc["parent"])
            .otherwise(F.lit(-1))
            .alias("parent"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(m["i"].alias("lo"), inherited.alias("parent"), is_parent.alias("skip"))
                ),
            ).alias("out"),
        )

    return F.aggregate(marks, start, step, lambda acc: acc["out"])


def sections_of_paragraphs(paragraphs: Column, include_parent_title: bool = True) -> Column:
    """Section array of an array of stripped, non-blank paragraph strings."""

    def with_openings(b: Column) -> Column:
        ps, opens = b["ps"], b["opens"]
        spans = F.filter(
            F.transform(
                opens,
                lambda o, k: F.struct(
                    o["lo"].alias("lo"),
                    o["parent"].alias("parent"),
                    o["skip"].alias("skip"),
                    (F.coalesce(F.get(opens, k + 1)["lo"], F.size(ps)) - o["lo"]).alias("n"),
                ),
            ),
            lambda s: ~s["skip"],
        )

        def section(s: Column, k: Column) -> Column:
            first = F.get(ps, s["lo"])
            # text before the first title forms a section without a title
            title = F.when(title_kind(first).isNotNull(), first).otherwise("")
            parent = F.when(s["parent"] >= 0, F.get(ps, s["parent"])).otherwise("")
            body = F.slice(ps, s["lo"] + 1, s["n"])
            if include_parent_title:
                body = F.concat(F.filter(F.array(parent), lambda x: x != ""), body)
            return section_struct(
                section_id_of(title, k + 1), title, parent, F.transform(body, markdown_paragraph)
            )

        return F.transform(spans, section)

    def with_kinds(ps: Column) -> Column:
        opens = let(F.transform(ps, title_kind), _openings)
        return let(F.struct(ps.alias("ps"), opens.alias("opens")), with_openings)

    return let(paragraphs, with_kinds)


# ---- operators ----------------------------------------------------------------------------
def classify_titles(
    df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "paragraph_ord")
) -> DataFrame:
    c = strip(F.col(content))
    numbered = is_numbered(c)
    chinese = is_chinese(c) & ~numbered
    document = is_doc_title(c)
    return df.select(
        *keep,
        numbered.alias("is_numbered"),
        chinese.alias("is_chinese"),
        document.alias("is_document"),
        (numbered | chinese | document).alias("is_title"),
    )


def build_sections(
    df: DataFrame,
    text: str = "text",
    include_parent_title: bool = True,
    pattern: str | None = None,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Add ``sections ARRAY<STRUCT>`` to every document."""
    ps = paragraph_array(F.col(text), pattern) if pattern else paragraph_array(F.col(text))
    return df.select(*keep, sections_of_paragraphs(ps, include_parent_title).alias("sections"))


def section_rows(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    rows = explode_pieces(df, F.col("sections"), "section_pos", "s", keep)
    return rows.select(*keep, (F.col("section_pos") + 1).alias("section_ord"), "s.*")
