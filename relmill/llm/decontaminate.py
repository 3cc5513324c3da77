"""Benchmark passages in documents, also with other numbers, names and units.

Texts become templates: numbers, units and names turn into typed placeholders. Windows of
``WINDOW`` words of all documents are joined with those of the benchmark by hash, as
templates and as written but for case.
Matches of one item whose diagonals (distances between both positions) are close to each
other form a place, so that inserted or missing words don't part it. In a place each of the
item's windows has one match: one equal as written, else the one on the diagonal with most.
Windows that are equal as written always count; the others count if each of their benchmark
values goes to one document value in the whole place. A document contains an item if the
counted windows of one place cover ``COVERAGE`` of the item's windows.

Only windows that may be the benchmark's leave the scan: a bitmap of fixed size, made from
the benchmark's windows, passes all of these and few others; the join then decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relmill.llm.common import WordCodes, bare, bounded_batches, numbered, stored, word_hash

WINDOW = 5
COVERAGE = 0.8
#: Bits of the bitmap, and of each of the parts in which it is gathered: 4 MB in all, whatever the benchmark.
BITMAP_BITS, PART_BITS = 25, 16
#: Words hashed together, about; one text may be longer.
TOGETHER = 1 << 17

_NUMBER = re.compile(r"[+-]?[0-9]+([.,:/][0-9]+)*")
_NUMBER_UNIT = re.compile(r"([+-]?[0-9]+(?:[.,][0-9]+)*)([^\W\d_]+|%|°[CF]?)")
_TRIM = re.compile(r"^[^\w+-]+|[^\w%°]+$")
UNITS = frozenset(
    "mm cm m km g kg mg ml l cl km/h mph lb lbs oz ft inch inches feet foot mile miles yard yards meter meters metre metres "
    "gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros pound pounds percent % °c °f".split()
)
_ENDS = (".", "!", "?", ":", ".\"", "!\"", "?\"")
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _code(word: str) -> int:
    """Hash of the bare word, its kind and whether a sentence ends with it, in one number."""
    plain = _TRIM.sub("", word)
    low = plain.lower()
    if _NUMBER.fullmatch(plain) or _NUMBER_UNIT.fullmatch(plain):
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif len(plain) > 1 and plain[0].isupper() and plain[1:].islower():
        kind = NAME
    else:
        kind = WORD
    return word_hash(bare(word) or word) << 3 | kind << 1 | word.endswith(_ENDS)


_codes = WordCodes(_code)


def _sums(values: np.ndarray, at: np.ndarray, width: int, names: int = 0) -> np.ndarray:
    """The hashes of the windows that start at ``at``, with placeholders for names where ``names`` has a bit."""
    h = np.full(len(at), width, np.uint64)
    for k in range(width):
        h = (h ^ (np.uint64(NAME << 40) if names >> k & 1 else values[at + k])) * _STEP
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _kinds(codes: np.ndarray, starts: np.ndarray, item: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sure kind of each word, and which words may be names or not, being at a sentence's start."""
    kinds, literal = codes >> 1 & 3, codes >> 3
    first = (kinds == NAME) & starts
    sure = np.where(first, WORD, kinds)
    if item:
        sure[first & np.isin(literal, literal[sure == NAME])] = NAME
        first[:] = False
    return sure, first


def templates(codes: np.ndarray, ends: np.ndarray, window: int, item: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None, int]]:
    """Windows of words, given by their codes, as (hashes, starts, sure kinds, mask of names at sentence starts).

    ``ends``: where texts end; no window spans two. As written comes first, which means
    without case, and has None for the kinds. Windows with placeholders also count as
    templates; one with less than two plain words says too little for it. A capitalised word
    is a name inside a sentence. At its start an ``item``'s word is a name if it is one
    elsewhere in the item; another text's word may be either, so its windows count in all ways.
    """
    begin = np.r_[0, ends[:-1]]
    starts = np.r_[True, codes[:-1] & 1 == 1]
    starts[begin[begin < len(codes)]] = True
    literal = (codes >> 3).astype(np.uint64)
    of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    at = np.arange(max(0, len(codes) - window + 1))
    at = at[of[at] == of[at + window - 1]]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, int]] = [(_sums(literal, at, window), at, None, 0)]
    sure, first = _kinds(codes, starts, item)
    slots = np.r_[0, np.cumsum(sure != WORD)]
    held = slots[at + window] - slots[at]
    abstract = np.where(sure == WORD, literal, sure.astype(np.uint64) << np.uint64(40))
    some = (held > 0) & (window - held >= 2)
    out.append((_sums(abstract, at[some], window), at[some], sure, 0))
    may = np.r_[0, np.cumsum(first)]
    some = np.flatnonzero(may[at + window] > may[at])
    at, held = at[some], held[some]
    names = np.zeros(len(at), np.int64)
    for k in range(window):
        names |= first[at + k].astype(np.int64) << k
    for mask in range(1, 1 << window):
        some = (names & mask == mask) & (window - held - mask.bit_count() >= 2)
        if some.any():
            out.append((_sums(abstract, at[some], window, mask), at[some], sure, mask))
    return out


def slot_values(words: list[str], kinds: list[int], names: int = 0) -> list[str]:
    """The values that stand for a window's placeholders, with their kind."""
    kinds = [NAME if names >> k & 1 else kind for k, kind in enumerate(kinds)]
    return [f"{kind}{bare(word) or word}" for word, kind in zip(words, kinds) if kind]


_WINDOWS = "_row long, id long, hash long, pos int, slots array<string>, literal boolean, n int"
_ARROW = pa.schema([("_row", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.string())), ("literal", pa.bool_()), ("n", pa.int32())])


def _windows(rows: DataFrame, window: int, bits: np.ndarray | None = None) -> DataFrame:
    """Windows of ``rows`` (_row, id, text), only those in the bitmap if there is one; n: the text's windows.

    Without a bitmap the rows are items; their windows as written also have their slots.
    """

    def found(cols: dict[str, list], rows: list[tuple[int, int | None]], texts: list[list[str]], width: int) -> None:
        words = [w for t in texts for w in t]
        ends = np.cumsum([len(t) for t in texts])
        ways = templates(_codes.array(words), ends, width, bits is None)
        for hashes, starts, sure, names in ways:
            seen = np.arange(len(hashes)) if bits is None else np.flatnonzero(_maybe(bits, hashes))
            own = ways[1][2] if bits is None else sure
            of = np.searchsorted(ends, starts[seen], side="right")
            for k, text in zip(seen.tolist(), of.tolist()):
                at = int(starts[k])
                slots = [] if own is None else slot_values(words[at : at + width], own[at : at + width].tolist(), names)
                n = len(texts[text])
                for name, v in zip(_ARROW.names, (*rows[text], int(hashes[k]), at - int(ends[text]) + n, slots, sure is None, n - width + 1)):
                    cols[name].append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in _ARROW.names}
            by_width: dict[int, tuple[list, list]] = {}
            held = 0
            for row, id_, text in zip(*(batch.column(n).to_pylist() for n in ("_row", "id", "text"))):
                words = (text or "").split()
                if words and bits is None:  # what a name is depends on the item
                    found(cols, [(row, id_)], [words], min(window, len(words)))
                elif words:
                    some = by_width.setdefault(min(window, len(words)), ([], []))
                    some[0].append((row, id_))
                    some[1].append(words)
                    held += len(words)
                if held > TOGETHER:
                    for width, part in by_width.items():
                        found(cols, *part, width)
                    by_width, held = {}, 0
            for width, part in by_width.items():
                found(cols, *part, width)
            yield pa.RecordBatch.from_pydict(cols, schema=_ARROW)

    return bounded_batches(rows).mapInArrow(run, _WINDOWS)


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Which values the windows' leading hash bits take; gathered in parts of ``PART_BITS`` bits."""

    def part(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << PART_BITS, bool)
        bits[group["bit"] & ((1 << PART_BITS) - 1)] = True
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    bit = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    distinct = windows.select(bit.alias("bit"), F.shiftright(bit, PART_BITS).cast("int").alias("part")).distinct()
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    for row in distinct.groupBy("part").applyInPandas(part, "part int, bits binary").toLocalIterator():
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> DataFrame:
    """(_row, doc_id, item_id, n_matched, n_windows, reparameterised) for ``docs`` (_row, id, text)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    items = items.where("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"))  # repeated items count once
    asked = stored(_windows(numbered(items), window))
    bits = _bitmap(asked)
    hits = _windows(docs, window, bits)
    right = asked.select(
        "hash", F.col("_row").alias("_item"), F.col("id").alias("item_id"), F.col("pos").alias("_ipos"), F.col("slots").alias("_islots"), "literal", F.col("n").alias("n_windows")
    )
    pairs = hits.select("_row", F.col("id").alias("doc_id"), "hash", "literal", "pos", "slots").join(right, ["hash", "literal"])
    # as written every value goes to itself
    pairs = pairs.withColumn("slots", F.when(F.col("literal"), F.col("_islots")).otherwise(F.col("slots")))
    zipped = F.arrays_zip(F.col("_islots").alias("i"), F.col("slots").alias("d"))
    hits = pairs.select(
        "_row", "doc_id", "_item", "item_id", "n_windows", F.col("_ipos").alias("at"), (F.col("pos") - F.col("_ipos")).alias("_shift"),
        F.col("_islots").eqNullSafe(F.col("slots")).alias("same"), zipped.alias("slots"),
    )
    # all that follows is dealt by row and item
    near = Window.partitionBy("_row", "_item")
    hits = hits.withColumn("_size", F.count("*").over(Window.partitionBy("_row", "_item", "_shift")))
    hits = hits.withColumn("_gap", F.col("_shift") - F.lag("_shift").over(near.orderBy("_shift")))
    hits = hits.withColumn("_place", F.count_if(F.col("_gap") > F.col("n_windows")).over(near.orderBy("_shift")))
    best = Window.partitionBy("_row", "_item", "_place", "at").orderBy(F.desc("same"), F.desc("_size"), "_shift")
    hits = hits.withColumn("_best", F.row_number().over(best)).where("_best = 1")
    places = hits.groupBy("_row", "doc_id", "_item", "item_id", "n_windows", "_place").agg(
        F.collect_list(F.struct("same", "slots")).alias("_hits")
    )
    # an item value with several document values: its windows are dropped, unless they are equal as written
    values = F.array_distinct(F.flatten("_hits.slots"))
    places = places.withColumn("_values", values).withColumn("_torn", F.filter("_values", lambda v: F.exists("_values", lambda w: (w["i"] == v["i"]) & (w["d"] != v["d"])))["i"])
    sound = F.filter("_hits", lambda h: h["same"] | ~F.exists(h["slots"], lambda v: F.array_contains("_torn", v["i"])))
    places = places.withColumn("_sound", sound)
    whole = places.groupBy("_row", "doc_id", "_item", "item_id", "n_windows").agg(
        F.max(F.struct(F.size("_sound").alias("n"), F.exists("_sound", lambda h: ~h["same"]).alias("changed"))).alias("_m")
    )
    whole = whole.select("_row", "doc_id", "item_id", "n_windows", F.col("_m.n").alias("n_matched"), F.col("_m.changed").alias("reparameterised"))
    return whole.where(F.col("n_matched") >= F.lit(coverage) * F.col("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_matched, n_windows, reparameterised): documents that contain benchmark items.

    One row for each document row and item; clean documents have none. ``docs`` (doc_id,
    text) and ``benchmark`` (item_id, text) may repeat rows: equal items count once, under
    their smallest id. Null and empty texts match nothing; a text of fewer than ``window``
    words matches only as a whole. ``reparameterised``: some value differs. Null ids stay null.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")))
    found = _matches(rows, benchmark, window, coverage)
    return found.select("doc_id", "item_id", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), "n_matched", "n_windows", "reparameterised")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; the columns are those of ``docs``.

    Null and empty texts stay, repeated rows share their verdict; an empty table or benchmark drops nothing.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    kept = stored(numbered(docs.toDF(*names)))
    rows = kept.select("_row", F.col("_row").alias("id"), F.col(at["text"]).cast("string").alias("text"))
    bad = stored(_matches(rows, benchmark, window, coverage).select("_row").distinct())  # its size is then known
    clean = kept.join(bad, "_row", "left_anti")
    return clean.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
