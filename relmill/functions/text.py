"""Column expressions shared by the operators.

Everything here is a plain Catalyst expression. Lengths, cuts and edit distances count
code points. Whitespace is spelled out as an explicit class because the built-in ``\\s``
and ``trim`` only know ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
WS = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
EDGE_PUNCT = " ，。；：,.;"
CJK_CHAR = r"[\x{4E00}-\x{9FFF}]"
#: Every character by itself: such a class is one table look-up, one with ranges a test for each of them.
LATIN_WORD = "[" + "".join(map(chr, (*range(65, 91), *range(97, 123), *range(48, 58)))) + r"_+\-]++"
#: Without the hyphen, which is part of latin words too.
TOKEN_PUNCT = "，。！？；：,.!?;:（）()【】[]“”\"'、"
# -------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    The optimizer inlines a projected column into lambda bodies, where it would be
    re-evaluated for every array element; a one-element transform pins it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def strip_edges(c: Column) -> Column:
    """Trim blanks and light punctuation from both ends."""
    return F.trim(c, F.lit(EDGE_PUNCT))


def is_blank(c: Column) -> Column:
    return strip(text_of(c)) == ""


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def compact(c: Column) -> Column:
    """Drop every whitespace character."""
    return F.translate(text_of(c), WS_CHARS, "")


def key_part(c: Column) -> Column:
    return F.lower(compact(c))


def contains(haystack: Column, needle: Column) -> Column:
    """Substring test that is false when either side is empty."""
    return (haystack != "") & (needle != "") & F.contains(haystack, needle)


def text_contains(haystack: Column, needle: Column) -> Column:
    """:func:`contains` on the whitespace-free forms."""
    return contains(compact(haystack), compact(needle))


def approx_tokens(c: Column) -> Column:
    """CJK characters + latin words + a quarter of the punctuation (at least one)."""
    hyphens = F.octet_length(c) - F.octet_length(F.replace(c, F.lit("-"), F.lit("")))

    def count(brief: Column) -> Column:
        size = F.char_length(brief)
        cjk = size - F.char_length(F.regexp_replace(brief, CJK_CHAR + "+", ""))
        words = size - F.char_length(F.replace(brief, F.lit("x"), F.lit("")))
        punct = size - F.char_length(F.translate(brief, TOKEN_PUNCT, "")) + hyphens
        # plain ASCII has no CJK characters to look for
        return (
            F.when(F.octet_length(brief) == size, 0).otherwise(cjk)
            + words
            + F.greatest(F.lit(1), F.floor(punct / 4).cast("int"))
        )

    # with every latin word as one letter the rest is short, and no other letter is left in it
    return let(F.regexp_replace(c, LATIN_WORD, "x"), count).cast("int")


def estimate_tokens(c: Column) -> Column:
    """Half the stripped length, rounded up; zero when blank."""
    return F.floor((F.char_length(strip(text_of(c))) + 1) / 2).cast("int")


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of ``literal``; byte lengths avoid rescans."""
    size = len(literal.encode("utf-8"))
    shrunk = F.replace(text, F.lit(literal), F.lit(""))
    count = ((F.octet_length(text) - F.octet_length(shrunk)) / size).cast("int")
    return F.when(F.contains(text, F.lit(literal)), count).otherwise(0)


def safe_filename(c: Column) -> Column:
    unified = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"/+$", "")
    base = F.element_at(F.split(unified, "/"), -1)
    cleaned = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f]+", "_"), "[/:]+", "_")
    return F.coalesce(null_if_empty(F.trim(cleaned, F.lit(" ."))), F.lit("upload"))


def doc_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def file_to_base64(c: Column) -> Column:
    return F.base64(c)


def safe_int(c: Column, default: Column | None = None) -> Column:
    cast = strip(c.cast("string")).try_cast("int")
    return cast if default is None else F.coalesce(cast, default)


def non_empty(arr: Column) -> Column:
    return F.filter(arr, lambda x: x != "")


def split_stripped(text: Column, pattern: str) -> Column:
    """Split, strip every piece, keep the non-blank ones."""
    return non_empty(F.transform(F.split(text, pattern), strip))


def unique_values(*arrays: Column) -> Column:
    """First-seen distinct values of the concatenated arrays, nulls removed."""
    joined = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return F.array_distinct(F.array_compact(joined))


def shortest(arr: Column) -> Column:
    """Shortest string of an array, the first one winning ties (null when empty)."""
    ranked = F.transform(
        arr, lambda x, i: F.struct(F.char_length(x).alias("n"), i.alias("i"), x.alias("v"))
    )
    return F.array_min(ranked).getField("v")


def greedy_starts(sizes: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """Start offsets of greedy packs over ``ARRAY<STRUCT<n INT, ...>>`` items.

    ``opens(total, item)`` says whether ``item`` must open a new pack, ``total`` being
    null before the first item and otherwise what ``item.add`` has summed up so far. The
    offsets array only grows when a pack opens, so the fold is linear in the items.
    """
    start = F.struct(
        F.lit(None).cast("long").alias("total"),
        F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, item: Column) -> Column:
        fresh = acc["total"].isNull() | opens(acc["total"], item)
        return F.struct(
            F.when(fresh, item["first"].cast("long"))
            .otherwise(acc["total"] + item["add"].cast("long"))
            .alias("total"),
            (acc["i"] + 1).alias("i"),
            F.when(fresh, F.concat(acc["starts"], F.array(acc["i"])))
            .otherwise(acc["starts"])
            .alias("starts"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["starts"])


def runs(starts: Column, total: Column) -> Column:
    """Turn sorted start offsets into ``ARRAY<STRUCT<lo, n>>`` covering up to ``total``."""
    return let(
        F.struct(starts.alias("s"), total.cast("int").alias("t")),
        lambda b: F.transform(
            b["s"],
            lambda lo, k: F.struct(
                lo.cast("int").alias("lo"),
                (F.coalesce(F.get(b["s"], k + 1), b["t"]) - lo).cast("int").alias("n"),
            ),
        ),
    )
