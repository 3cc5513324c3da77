"""Removes bytes that repeat: every byte covered by a ``LENGTH``-byte string that also starts elsewhere.

Two suffixes matter to each other only if their first ``LENGTH`` bytes agree, so suffixes
are resolved to that depth, one bucket at a time, with ranks of a cover sample deciding
the long ties:

1. *Cover sample.* In each ``LENGTH``-byte string the ``GRAM``-byte string with the least
   hash is its sample place. Like a difference cover this has, for any two equal strings, a
   common offset at which both are sampled, but it samples under one byte in a hundred where
   residues modulo a number need six or more. The sample's hash names the suffix bucket.
2. *Buckets.* Neighbouring suffixes with the same sample place form a run. A run whose whole
   content stands in its bucket twice is settled at once. Where a bucket holds runs that
   differ, its suffixes are cut into cells of ``CELL`` starts, aligned to the sample place.
3. *Ties.* All suffixes of a cell share its core (``LENGTH`` - ``CELL`` + 1 bytes). Cores get a
   rank (a 128-bit class; only equality matters). A suffix is then its core's rank and the
   at most ``CELL`` - 1 bytes before and behind, and equal ones are counted.

Buckets are grouped by Spark with counts combined before each shuffle and never gathered
whole, so a passage that a third of all documents share stays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import bounded_batches, stored, with_columns

LENGTH, GRAM, CELL = 400, 160, 16
#: Starts that are hashed together; bounds the memory of a long text.
CHUNK = 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


_tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _table(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo 2^64, ``n`` of each at least."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _tables:
        _tables[size] = [(_powers(b, size), _powers(pow(b, -1, 1 << 64), size)) for b in _BASES]
    return _tables[size]


class Hashes:
    """Hashes of any stretch of some bytes, from sums over their beginnings."""

    def __init__(self, raw: bytes) -> None:
        self.tables = _table(len(raw) + 1)
        values = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = []
        for power, _ in self.tables:
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(values * power[: len(raw)], out=total[1:])
            self.sums.append(total)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        h = (self.sums[which][end] - self.sums[which][start]) * self.tables[which][1][start]
        return self._mixed(h)

    def all(self, size: int) -> np.ndarray:
        sums, inverse = self.sums[0], self.tables[0][1]
        return self._mixed((sums[size:] - sums[:-size]) * inverse[: len(sums) - size])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` neighbours."""
    rest = -len(values) % width
    blocks = np.concatenate([values, np.full(rest, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """Runs of starts with one sample place, as arrays: bucket, hash of the content, first start, last start, place.

    Bucket and hash are 64 bits each, from different bytes: together they name the content.
    """
    out = []
    for base in range(0, max(0, len(raw) - length + 1), CHUNK):
        part = raw[base : base + CHUNK + length - 1]
        if len(part) < length:
            break
        hashes = Hashes(part)
        grams = hashes.all(gram)
        width = length - gram + 1
        least = _slide_min(grams, width)
        # the place is the first one with the least hash, which depends on the string alone
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        low, high = np.r_[0, cut], np.r_[cut - 1, len(least) - 1]
        low, high, place = _split_places(grams, least, low, high, width)
        size = (high - low + 1).astype(np.uint64)
        content = hashes.of(low, high + length, 1) ^ size * _MIX
        out.append((grams[place].view(np.int64), content.view(np.int64), low + base, high + base, place + base))
    return out


def _split_places(grams: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Splits runs of one least hash where its first place moves on (the hash repeats close by)."""
    spots = np.flatnonzero(np.isin(grams, least[low]))
    lows, highs, places = [], [], []
    run_of = least[low]
    # the first spot with the run's hash at or after each start
    by_hash: dict[int, np.ndarray] = {}
    values = grams[spots]
    order = np.argsort(values, kind="stable")
    sorted_values, sorted_spots = values[order], spots[order]
    begin = np.searchsorted(sorted_values, run_of, side="left")
    end = np.searchsorted(sorted_values, run_of, side="right")
    simple = end - begin == 1
    if simple.all():
        return low, high, sorted_spots[begin]
    del by_hash
    for k in range(len(low)):
        if simple[k]:
            lows.append(low[k : k + 1]), highs.append(high[k : k + 1]), places.append(sorted_spots[begin[k] : begin[k] + 1])
            continue
        at = sorted_spots[begin[k] : end[k]]
        at = at[(at >= low[k]) & (at < high[k] + width)]
        # starts up to a place have it first; the next place serves the starts behind it
        ends = np.minimum(at, high[k])
        starts = np.r_[low[k], ends[:-1] + 1]
        keep = starts <= ends
        lows.append(starts[keep]), highs.append(ends[keep]), places.append(at[keep])
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(places)


#: What names a row: the same in every computation, whatever the splits of the scan. Rows that share it are equal.
KEY = ["_id", "_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _id, _hash) of ``docs`` (doc_id, text): 128 bits that depend on both values alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("*", F.coalesce("doc_id", F.xxhash64(F.lit(7), "text")).alias("_id"), F.xxhash64("doc_id", "text").alias("_hash"))


_RUNS = "_id long, _hash long, bucket long, content long, low long, high long, place long"
_RUNS_ARROW = pa.schema([(n, pa.int64()) for n in (*KEY, "bucket", "content", "low", "high", "place")])


def _run_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for part in runs((text or "").encode("utf-8", "surrogatepass"), length, gram):
                    named = [pa.array(np.full(len(part[0]), k)) for k in key]
                    yield pa.RecordBatch.from_arrays([*named, *map(pa.array, part)], schema=_RUNS_ARROW)

    return bounded_batches(docs.select(*KEY, "text")).mapInArrow(make, _RUNS)


_CELLS = "_id long, _hash long, r1 long, r2 long, start long, first int, last int, head binary, tail binary"
_CELLS_ARROW = pa.schema(
    [*((n, pa.int64()) for n in KEY), ("r1", pa.int64()), ("r2", pa.int64()), ("start", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("head", pa.binary()), ("tail", pa.binary())]
)


def cells(raw: bytes, low: int, high: int, place: int, length: int, cell: int) -> list[tuple]:
    """The cells of a run: two hashes of the core, start, first and last offset in use, bytes before and behind the core.

    A cell starts a multiple of ``cell`` before the sample place, so that equal suffixes get
    equal cells. Its core is what all its suffixes share.
    """
    out = []
    for k in range(-(-(place - high) // cell), -(-(place - low) // cell) + 1):
        start = place - k * cell
        first, last = max(low - start, 0), min(high - start, cell - 1)
        core = raw[start + cell - 1 : start + length]
        digest = hashlib.blake2b(core, digest_size=16).digest()
        head = raw[start + first : start + cell - 1]
        tail = raw[start + length : start + length + last]
        out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), start, first, last, head, tail))
    return out


def _cell_rows(texts: DataFrame, length: int, cell: int) -> DataFrame:
    """Cells of the runs listed with each text: ``texts`` (_id, _hash, text, asked array of low, high, place)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                found = [c for a in asked for c in cells(raw, a["low"], a["high"], a["place"], length, cell)]
                cols = [[k] * len(found) for k in key] + list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CELLS_ARROW.types)], schema=_CELLS_ARROW)

    return bounded_batches(texts.select(*KEY, "text", "asked")).mapInArrow(make, _CELLS)


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(_id, _hash, start, end): byte ranges of ``rows``, as ``keyed`` makes them, that repeated strings cover; they may overlap."""
    if not 1 < cell <= gram < length:
        raise ValueError("1 < cell <= gram < length must hold")
    all_runs = stored(_run_rows(rows, length, gram))
    # a bucket matters if it has several runs; the others, most of them, go no further
    # written first, so that the join below has shuffles of its own, whose hot partitions Spark can split
    shared = stored(all_runs.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    live = stored(all_runs.join(shared, "bucket", "left_semi"))
    same = ["bucket", "content"]
    where = F.struct(*KEY, "low", "high", "place")
    classes = stored(live.groupBy(*same).agg(F.count("*").alias("n"), F.min(where).alias("at")))
    # its classes must be compared if they are several
    buckets = classes.groupBy("bucket").agg(F.count("*").alias("kinds"))
    whole = live.join(classes.where("n > 1").select(*same), same, "left_semi").select(*KEY, F.col("low").alias("start"), (F.col("high") + length).alias("end"))

    open_ = classes.join(buckets.where("kinds > 1").select("bucket"), "bucket", "left_semi")
    asked = open_.select("at.*").groupBy(*KEY).agg(F.collect_list(F.struct("low", "high", "place")).alias("asked"))
    made = stored(_cell_rows(rows.join(asked, KEY), length, cell))
    # runs that were settled above stand here once; the classes' counts tell that they repeat anyway
    flank = ["r1", "r2", "first", "last", "head", "tail"]
    kinds = stored(made.groupBy(*flank).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start")).alias("at")))
    equal = made.join(kinds.where("n > 1").select(*flank), flank, "left_semi").select(
        *KEY, (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + length).alias("end")
    )
    # only where a core stands between different bytes are its suffixes told apart
    mixed = kinds.groupBy("r1", "r2").agg(F.count("*").alias("k")).where("k > 1").select("r1", "r2")
    offset = F.explode(F.sequence("first", "last")).alias("t")
    suffixes = kinds.join(mixed, ["r1", "r2"], "left_semi").select("r1", "r2", "n", "at", "first", "head", "tail", offset).select(
        "r1", "r2", "n", "at", "t",
        F.expr("substring(head, t - first + 1)").alias("before"), F.expr("substring(tail, 1, t)").alias("behind"),
    )
    key = ["r1", "r2", "t", "before", "behind"]
    twice = suffixes.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1").select(*key)
    single = suffixes.where("n = 1").join(twice, key, "left_semi").select(
        *[F.col(f"at.{n}") for n in KEY], (F.col("at.start") + F.col("t")).alias("start"), (F.col("at.start") + F.col("t") + length).alias("end")
    )
    return whole.unionByName(equal).unionByName(single)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as ranges that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), one row per row of ``docs`` (doc_id, text).

    Texts count as UTF-8 bytes, null as empty; strings don't cross texts. ``kept`` is what
    remains (it may cut a character); ``n_spans`` counts maximal removed runs. Rows that
    repeat are copies of each other and go whole if they have ``length`` bytes. Ids may
    repeat or be null. ``docs`` is read three times and not copied: rows are named by their values.
    """
    rows = keyed(docs)
    ranges = repeated_ranges(rows, length, gram, cell)
    # as a set, since rows that repeat name the same ranges
    lists = ranges.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("_gone"))
    told = rows.join(lists, KEY, "left").select("doc_id", F.struct("text", "_gone").alias("_t"))

    def cut(values: list[dict]) -> list[list]:
        out = []
        for v in values:
            raw = (v["text"] or "").encode("utf-8", "surrogatepass")
            gone = merged([(r["start"], r["end"]) for r in v["_gone"] or []])
            ends = [0, *(b for _, b in gone)]
            kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(raw)]))
            out.append((len(raw), len(raw) - len(kept), len(gone), kept))
        return list(zip(*out)) if out else [[]] * 4

    return with_columns(told, "_t", {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}, cut)
