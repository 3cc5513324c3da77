"""Text cleaning and splitting.

All operators work inside one document row, so none of them shuffles: the input is a
table with a text column, the output one row per piece (``posexplode``) or one more column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import posexplode
from relmill.functions.text import (
    WS,
    approx_tokens,
    greedy_starts,
    let,
    non_empty,
    runs,
    split_stripped,
    strip,
    strip_edges,
    text_of,
)

# ---- fixed values: image markup, section markers, sentence ends ------------------------
HTML_IMAGE = r"(?is)<img\b[^>]*>"
INLINE_IMAGE = r"!\[[^\]\n]*\]\(" + WS + r"*(?:<[^>\n]*>|[^)\n]*)" + WS + r"*\)"
REFERENCE_IMAGE = r"!\[[^\]\n]*\]\[[^\]\n]*\]"
IMAGE_DEFINITION = (
    r"(?imd)^[ \t]*\[[^\]\n]+\]:[ \t]*"
    r"(?:data:image/\S+|(?:\.{0,2}/)?(?:images?|figures?|assets?)/\S+|attachment:\S+).*$"
)
DATA_URI = r"data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=\r\n]+"
TRAILING_BLANKS, BLANK_RUN, EMPTY_LINES = r"[ \t]+\n", r"[ \t]{2,}", r"\n{3,}"
SECTION_MARKER = (
    r"第[一二三四五六七八九十百千万\p{Nd}]+阶段"
    r"|[（(][一二三四五六七八九十百千万\p{Nd}]+[）)]"
    r"|\p{Nd}+[.．、](?=" + WS + r"|[\x{4E00}-\x{9FFF}A-Za-z])"
    r"|[一二三四五六七八九十]+[、.．]"
)
MARKER_LEAD = r"[\n。！？!?；;]"
EVIDENCE_BREAK = r"[。！？!?；;\n]+"
HARD_CUT_SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ")
# -----------------------------------------------------------------------------------------


def explode_pieces(
    df: DataFrame, pieces: Column, ord_name: str, value_name: str, keep: tuple[str, ...]
) -> DataFrame:
    """One row per array element with its 0-based position."""
    return df.select(*keep, posexplode(pieces).alias(ord_name, value_name))


# ---- expressions -------------------------------------------------------------------------
def clean_images(c: Column) -> Column:
    out = text_of(c)
    for pattern in (HTML_IMAGE, INLINE_IMAGE, REFERENCE_IMAGE, IMAGE_DEFINITION, DATA_URI):
        out = F.regexp_replace(out, pattern, "")
    for pattern, by in ((TRAILING_BLANKS, "\n"), (BLANK_RUN, " "), (EMPTY_LINES, "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def paragraph_array(c: Column, pattern: str = r"\n" + WS + r"*\n+") -> Column:
    return split_stripped(text_of(c), pattern)


def sentence_array(c: Column) -> Column:
    """Sentence ends become line breaks first, so one split does the rest."""
    marked = F.regexp_replace(c, "([。！？!?])", "$1\n")
    marked = F.regexp_replace(marked, r"\." + WS + "+", ".\n")
    return let(
        split_stripped(marked, r"\n+"),
        lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(c)),
    )


def evidence_array(c: Column) -> Column:
    return non_empty(F.transform(F.split(c, EVIDENCE_BREAK), strip_edges))


def outline_array(c: Column) -> Column:
    unified = F.regexp_replace(c, r"\r\n?", "\n")
    # a marker at the very start opens no new piece, so only led markers need a cut; the cut is
    # a place between two characters and takes none that the text may hold
    return split_stripped(unified, f"(?<={MARKER_LEAD}){WS}*(?={SECTION_MARKER})")


def unit_array(c: Column, budget: int) -> Column:
    """Outline sections, those over budget replaced by their sentences."""
    return F.flatten(
        F.transform(
            outline_array(c),
            lambda s: F.when(approx_tokens(s) <= budget, F.array(s)).otherwise(sentence_array(s)),
        )
    )


def pack_by_tokens(units: Column, budget: int) -> Column:
    """Greedy in-order packing; units over budget stay whole."""

    def pack(u: Column) -> Column:
        sized = F.transform(
            u, lambda x: let(approx_tokens(x), lambda n: F.struct(n.alias("add"), n.alias("first")))
        )
        starts = greedy_starts(sized, lambda total, it: total + it["add"] > budget)
        return F.transform(
            runs(starts, F.size(u)),
            lambda r: strip(F.array_join(F.slice(u, r["lo"] + 1, r["n"]), " ")),
        )

    return let(units, pack)


def pieces_by_chars(c: Column, limit: int) -> Column:
    """Pack paragraphs up to ``limit`` characters, cutting longer ones at exactly ``limit``.

    One left-to-right regex walk over the paragraph-joined text: take the longest prefix
    that ends at a paragraph break (or at the end), else cut at the limit.
    """
    joined = F.array_join(split_stripped(c, r"\n{2,}"), "\n\n")
    walk = rf"(?s){WS}*+(.{{1,{limit}}}(?=\n\n|\z)|.{{{limit}}})"
    pieces = F.transform(F.regexp_extract_all(joined, F.lit(walk), 1), strip)
    blank = F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    return F.when(strip(c) == "", blank).otherwise(pieces)


def hard_cut_array(c: Column, max_tokens: int) -> Column:
    """Cut every ``2 * max_tokens`` characters, preferably behind a separator.

    Separators are tried in priority order; one counts when it sits in the second half of
    the window. A greedy bounded quantifier finds the last such position, so the whole
    operation is a single linear regex walk. The first half is walked once for all separators,
    and a rest within the window is told without going back.
    """
    window = max(1, int(max_tokens) * 2)
    floor = max(1, window // 2)
    behind = "|".join(
        rf".{{0,{window - len(sep) - floor}}}{sep}"
        for sep in HARD_CUT_SEPARATORS
        if window - len(sep) >= floor
    )
    options = [rf".{{1,{window}}}+\z", *([rf".{{{floor}}}(?:{behind})"] if behind else []), rf".{{{window}}}"]
    walk = rf"(?s){WS}*+({'|'.join(options)})"
    return F.transform(F.regexp_extract_all(strip(text_of(c)), F.lit(walk), 1), strip)


def page_chunk_array(pages: Column, limit: int) -> Column:
    """Pack ``ARRAY<STRUCT<page_index, text>>`` into chunks of at most ``limit`` characters.

    A page over the limit is cut on its own and never shares a chunk.
    """
    trimmed = F.filter(
        F.transform(
            pages,
            lambda p: F.struct(p["page_index"].alias("page"), strip(text_of(p["text"])).alias("t")),
        ),
        lambda p: p["t"] != "",
    )
    items = F.flatten(
        F.transform(
            trimmed,
            lambda p: let(
                F.char_length(p["t"]) > limit,
                lambda solo: F.transform(
                    F.when(solo, pieces_by_chars(p["t"], limit)).otherwise(F.array(p["t"])),
                    lambda x: F.struct(
                        p["page"].cast("int").alias("page"),
                        x.alias("t"),
                        solo.alias("solo"),
                        (F.char_length(x) + 2).alias("add"),
                        # a cut piece fills its chunk: nothing can follow it
                        F.when(solo, F.lit(limit + 1)).otherwise(F.char_length(x)).alias("first"),
                    ),
                ),
            ),
        )
    )

    def pack(its: Column) -> Column:
        starts = greedy_starts(
            its, lambda total, it: it["solo"] | (total + it["add"] > limit)
        )
        return F.transform(
            runs(starts, F.size(its)),
            lambda r: let(
                F.slice(its, r["lo"] + 1, r["n"]),
                lambda part: F.struct(
                    F.array_join(F.transform(part, lambda x: x["t"]), "\n\n").alias("text"),
                    F.get(part, F.lit(0))["page"].alias("page_start"),
                    F.element_at(part, -1)["page"].alias("page_end"),
                ),
            ),
        )

    return let(items, pack)


# ---- operators ----------------------------------------------------------------------------
def strip_image_markup(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean_images(F.col(text)))


def split_paragraphs(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pattern: str | None = None
) -> DataFrame:
    pieces = paragraph_array(F.col(text), pattern) if pattern else paragraph_array(F.col(text))
    return explode_pieces(df, pieces, "paragraph_ord", "content", keep)


def split_sentences(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return explode_pieces(df, sentence_array(F.col(text)), "sentence_ord", "sentence", keep)


def sentence_segments(
    df: DataFrame, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The first ``limit`` sentences that end before a blank."""
    pieces = split_stripped(F.col(text), f"(?<=[。！？.!?]){WS}+")
    return explode_pieces(df, F.slice(pieces, 1, limit), "segment_ord", "segment", keep)


def evidence_units(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return explode_pieces(df, evidence_array(F.col(text)), "unit_ord", "unit", keep)


def split_outline(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return explode_pieces(df, outline_array(F.col(text)), "piece_ord", "piece", keep)


def outline_units(
    df: DataFrame, budget: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    return explode_pieces(df, unit_array(F.col(text), budget), "unit_ord", "unit", keep)


def chunk_by_tokens(
    df: DataFrame,
    budget: int,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    sentences_only: bool = False,
) -> DataFrame:
    source = F.col(text)
    units = sentence_array(source) if sentences_only else unit_array(source, budget)
    return explode_pieces(df, pack_by_tokens(units, budget), "chunk_index", "chunk_text", keep)


def chunk_by_chars(
    df: DataFrame, limit: int, pages: str = "pages", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    rows = explode_pieces(df, page_chunk_array(F.col(pages), limit), "pos", "chunk", keep)
    return rows.select(
        *keep,
        F.concat(F.lit("chunk-"), F.col("pos") + 1).alias("chunk_id"),
        "chunk.text",
        "chunk.page_start",
        "chunk.page_end",
    )


def split_long_text(
    df: DataFrame, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    return explode_pieces(df, pieces_by_chars(F.col(text), limit), "piece_ord", "piece", keep)


def hard_split(
    df: DataFrame, max_tokens: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    return explode_pieces(df, hard_cut_array(F.col(text), max_tokens), "piece_ord", "piece", keep)


def corpus_profile(
    df: DataFrame, trigger: int, budget: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Token count, chunking decision and chunk count of every document."""
    counted = df.withColumn("doc_token_count", approx_tokens(F.col(text)))
    used = F.col("doc_token_count") > trigger
    chunks = F.size(pack_by_tokens(unit_array(F.col(text), budget), budget))
    return counted.select(
        *keep,
        "doc_token_count",
        used.alias("used_chunking"),
        F.when(used, chunks).otherwise(1).alias("chunk_count"),
    )
