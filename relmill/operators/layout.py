"""Shaping layout-recognition results into pages, paragraphs and document text.

One layout result is one row with its block (or page) array, as it is read from JSON, so
every step is a projection over that array; exploding happens only for flat outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import inline, posexplode
from relmill.functions.text import is_blank, let, null_if_empty, runs, strip, text_of
from relmill.operators.text import clean_images

# ---- fixed values -------------------------------------------------------------------------
NON_TEXT_LABELS = (
    "number", "footnote", "header", "header_image", "footer", "footer_image", "aside_text", "seal",
)
FLOATING_LABELS = ("aside_text", "seal")
# -------------------------------------------------------------------------------------------
BLOCK_TYPE = (
    "struct<block_label:string,block_content:string,block_bbox:array<double>,block_id:int,"
    "global_block_id:int,group_id:int,global_group_id:int,page:int>"
)
BLOCKS_SCHEMA = f"page_count int, parsing_res_list array<{BLOCK_TYPE}>"
MARKDOWN_TYPE = (
    "struct<markdownText:string,text:string,content:string,images:map<string,string>>"
)
PAGE_RESULT_TYPE = (
    f"struct<prunedResult:string,markdown:{MARKDOWN_TYPE},markdownText:string,text:string>"
)
LAYOUT_SCHEMA = f"{BLOCKS_SCHEMA}, layoutParsingResults array<{PAGE_RESULT_TYPE}>"
RESTRUCTURED_TYPE = (
    "struct<markdownText:string,markdown:string,text:string,"
    f"layoutParsingResults:array<{PAGE_RESULT_TYPE}>>"
)
PAGE_TYPE = "struct<page_index:int,pruned_result:string,markdown_text:string>"


def _first_text(*options: Column) -> Column:
    return F.coalesce(*[null_if_empty(o) for o in options], F.lit(""))


def block_key(block: Column, default: Column) -> Column:
    return F.coalesce(block["global_block_id"], block["block_id"], default)


def paged_blocks(blocks: Column) -> Column:
    """``ARRAY<STRUCT<block, page>>``: the page in force at every block.

    A page break is a block of group 0 that follows an eligible block of group >= 0;
    blocks with an explicit page and floating labels neither break nor count. Between two
    breaks all blocks share one page, so the array is cut at the breaks and numbered.
    """

    def number(bs: Column) -> Column:
        eligible = F.filter(
            F.transform(
                bs,
                lambda b, i: F.struct(
                    i.alias("i"),
                    F.coalesce(b["group_id"], F.lit(0)).alias("g"),
                    (
                        b["page"].isNull()
                        & ~F.coalesce(b["block_label"], F.lit("")).isin(*FLOATING_LABELS)
                    ).alias("ok"),
                ),
            ),
            lambda e: e["ok"],
        )

        def cut(es: Column) -> Column:
            breaks = F.filter(
                F.transform(
                    es,
                    lambda e, k: F.when(
                        (k > 0) & (e["g"] == 0) & (F.get(es, k - 1)["g"] >= 0), e["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.flatten(
                F.transform(
                    runs(F.concat(F.array(F.lit(0)), breaks), F.size(bs)),
                    lambda r, k: F.transform(
                        F.slice(bs, r["lo"] + 1, r["n"]),
                        lambda b: F.struct(
                            b.alias("block"), F.coalesce(b["page"], k + 1).alias("page")
                        ),
                    ),
                )
            )

        return let(eligible, cut)

    known = F.filter(F.coalesce(blocks, F.array().cast(f"array<{BLOCK_TYPE}>")), lambda b: b.isNotNull())
    return let(known, number)


def page_map(paged: Column) -> Column:
    """``MAP<block key, page>``; of blocks with one key the last wins."""
    keyed = F.array_sort(
        F.transform(
            paged,
            lambda b, i: F.struct(
                block_key(b["block"], F.lit(0)).alias("key"), i.alias("i"), b["page"].alias("page")
            ),
        )
    )
    return let(
        keyed,
        lambda ks: F.map_from_entries(
            F.transform(
                F.filter(
                    ks, lambda k, i: ~k["key"].eqNullSafe(F.get(ks, i + 1)["key"])
                ),
                lambda k: F.struct(k["key"], k["page"]),
            )
        ),
    )


def is_text_block(block: Column) -> Column:
    return ~is_blank(block["block_content"]) & ~F.coalesce(block["block_label"], F.lit("")).isin(
        *NON_TEXT_LABELS
    )


def block_paragraphs(blocks: Column) -> Column:
    """One paragraph struct per text block."""

    def shape(paged: Column) -> Column:
        texts = F.filter(F.transform(paged, lambda b: b["block"]), is_text_block)
        return let(
            page_map(paged),
            lambda pages: F.transform(
                texts,
                lambda b, i: let(
                    block_key(b, i),
                    lambda key: F.struct(
                        F.coalesce(F.try_element_at(pages, key), F.lit(1)).alias("page"),
                        F.coalesce(b["block_label"], F.lit("")).alias("label"),
                        strip(b["block_content"]).alias("content"),
                        b["block_bbox"].alias("bbox"),
                        key.alias("global_block_id"),
                        b["group_id"].alias("group_id"),
                        b["global_group_id"].alias("global_group_id"),
                    ),
                ),
            ),
        )

    return let(paged_blocks(blocks), shape)


def block_pages(blocks: Column, page_count: Column) -> Column:
    """``ARRAY<STRUCT<page_index, pruned_result, markdown_text>>`` of a block list.

    Text blocks sorted by (page, position) are cut where the page changes; pages outside
    1..page_count (default: the highest page) are left out.
    """

    def shape(paged: Column) -> Column:
        texts = F.filter(F.transform(paged, lambda b: b["block"]), is_text_block)
        placed = let(
            page_map(paged),
            lambda pages: F.array_sort(
                F.transform(
                    texts,
                    lambda b, i: F.struct(
                        F.coalesce(
                            F.try_element_at(pages, block_key(b, F.lit(0))), F.lit(1)
                        ).alias("page"),
                        i.alias("i"),
                        b.alias("block"),
                    ),
                )
            ),
        )

        def cut(ps: Column) -> Column:
            starts = F.array_compact(
                F.transform(
                    ps,
                    lambda p, k: F.when((k == 0) | (p["page"] != F.get(ps, k - 1)["page"]), k),
                )
            )
            grouped = F.transform(
                runs(starts, F.size(ps)),
                lambda r: let(
                    F.slice(ps, r["lo"] + 1, r["n"]),
                    lambda part: F.struct(
                        F.get(part, F.lit(0))["page"].alias("page_index"),
                        F.to_json(
                            F.struct(F.transform(part, lambda p: p["block"]).alias("blocks"))
                        ).alias("pruned_result"),
                        strip(
                            F.array_join(
                                F.transform(part, lambda p: strip(p["block"]["block_content"])),
                                "\n\n",
                            )
                        ).alias("markdown_text"),
                    ),
                ),
            )
            last = F.coalesce(
                F.nullif(page_count, F.lit(0)),
                F.array_max(F.transform(ps, lambda p: p["page"])),
                F.lit(1),
            )
            return F.filter(grouped, lambda g: g["page_index"].between(1, last))

        return F.when(F.size(texts) > 0, let(placed, cut)).otherwise(
            F.array().cast(f"array<{PAGE_TYPE}>")
        )

    return let(paged_blocks(blocks), shape)


def result_pages(results: Column) -> Column:
    """Pages of a page-shaped result; the text sits in one of four places."""
    return F.transform(
        F.coalesce(results, F.array().cast(f"array<{PAGE_RESULT_TYPE}>")),
        lambda p, i: F.struct(
            (i + 1).alias("page_index"),
            F.coalesce(p["prunedResult"], F.lit("{}")).alias("pruned_result"),
            strip(
                _first_text(
                    p["markdown"]["markdownText"],
                    p["markdown"]["text"],
                    p["markdown"]["content"],
                    p["markdownText"],
                )
            ).alias("markdown_text"),
        ),
    )


def layout_page_array() -> Column:
    """Pages of either result shape (columns of ``LAYOUT_SCHEMA``)."""
    return F.when(
        F.col("parsing_res_list").isNotNull(),
        block_pages(F.col("parsing_res_list"), F.col("page_count")),
    ).otherwise(result_pages(F.col("layoutParsingResults")))


# ---- operators ----------------------------------------------------------------------------
def infer_block_pages(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Page of every block; blocks sharing a key all report the last one's page."""
    paged = df.withColumn("_p", paged_blocks(F.col("parsing_res_list")))
    mapped = paged.withColumn("_m", page_map(F.col("_p")))
    rows = mapped.select(*keep, "_m", posexplode("_p").alias("block_ord", "_b"))
    key = block_key(F.col("_b.block"), F.lit(0))
    return rows.select(
        *keep, "block_ord", key.alias("block_key"), F.try_element_at(F.col("_m"), key).alias("page")
    )


def filter_text_blocks(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    rows = df.select(*keep, posexplode("parsing_res_list").alias("block_ord", "b"))
    return rows.filter(F.col("b").isNotNull() & is_text_block(F.col("b"))).select(
        *keep, "block_ord", "b.*"
    )


def pages_from_blocks(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    pages = block_pages(F.col("parsing_res_list"), F.col("page_count"))
    return df.select(*keep, inline(pages))


def paragraphs_from_blocks(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    rows = df.select(
        *keep, posexplode(block_paragraphs(F.col("parsing_res_list"))).alias("paragraph_ord", "p")
    )
    return rows.select(*keep, "paragraph_ord", "p.*")


def layout_pages(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Block pages re-projected to the page-shaped result."""
    return pages_from_blocks(df, keep).select(
        *keep,
        "page_index",
        F.col("pruned_result").alias("prunedResult"),
        F.struct(
            F.col("markdown_text").alias("text"),
            F.lit(None).cast("map<string,string>").alias("images"),
        ).alias("markdown"),
    )


def _page_join(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n\n")


def restructured_text(result: Column, pages: Column) -> Column:
    """Text of a restructured result, else its page texts, else the recognised pages."""
    own = _first_text(result["markdownText"], result["markdown"], result["text"])
    collected = _page_join(
        F.transform(
            result["layoutParsingResults"],
            lambda p: strip(
                F.when(
                    p["markdown"].isNotNull(),
                    _first_text(
                        p["markdown"]["markdownText"], p["markdown"]["text"], p["markdown"]["content"]
                    ),
                ).otherwise(text_of(p["text"]))
            ),
        )
    )
    fallback = _page_join(F.transform(pages, lambda p: p["markdown_text"]))
    return strip(_first_text(own, collected, fallback))


def restructured_or_pages(
    df: DataFrame, result: str = "restructured", pages: str = "pages"
) -> DataFrame:
    return df.withColumn("markdown_text", restructured_text(F.col(result), F.col(pages)))


def assemble_document(
    df: DataFrame,
    result: str = "restructured",
    pages: str = "pages",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Final document text per layout result.

    A null restructured result means the restructuring failed; a result without pages is an
    error row. Text that vanishes with its images is replaced by the cleaned page texts.
    """
    has_pages = F.size(F.coalesce(F.col(pages), F.array().cast(f"array<{PAGE_TYPE}>"))) > 0
    cleaned = F.transform(F.col(pages), lambda p: clean_images(p["markdown_text"]))
    whole = clean_images(restructured_text(F.col(result), F.col(pages)))
    text = let(whole, lambda t: F.when(t != "", t).otherwise(_page_join(cleaned)))
    return df.select(
        *keep,
        F.when(has_pages, text).alias("document_text"),
        F.when(has_pages, F.col(result).isNull()).alias("ocr_restructure_fallback"),
        F.when(has_pages, F.size(pages)).otherwise(0).alias("page_count"),
        F.when(~has_pages, F.lit("no pages recognised")).alias("error"),
    )
