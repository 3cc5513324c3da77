"""Near-duplicate documents by SimHash, compared exactly in tiles.

Fingerprints are computed per document. Equal fingerprints collapse first; the distinct
ones are compared in tiles. A tile is keyed by the bit counts of the fingerprint's four
16-bit quarters: two fingerprints within ``radius`` bits differ by at most ``radius`` in
the sum of these counts' differences, so tile pairs further apart are never formed. What
remains is compared exactly with exclusive-or and bit counts in numpy. A tile holds at most
about ``TILE`` fingerprints; a larger cell becomes several tiles and every pair of them is
a row of its own. A tile pair emits a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import numbered, stored, with_columns
from relmill.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
TILE = 4096


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(words[i:] for i in range(size)))
    n = len(words) - size + 1
    hashes = np.fromiter((digest(s, seed) for s in map(b" ".join, shingles)), np.uint64, n)
    ones = _bit_sums(hashes)
    return int(np.sum(_POWERS[2 * ones > n], dtype=np.uint64))


_POWERS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(columns) < 256:
        return np.unpackbits(columns, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])


def with_fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, _fp long): one row per row of ``docs``."""

    def prints(texts: list[str | None]) -> list[np.ndarray]:
        return [np.array([fingerprint(t, size, seed) for t in texts], np.uint64).view(np.int64)]

    return with_columns(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", {"_fp": "long"}, prints
    )


def _quarter(k: int):
    return F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int")


def _cell():
    """The quarters' bit counts, 8 bits each; 2 is added so that a neighbour never borrows."""
    cell = F.lit(0)
    for k in range(4):
        cell = cell + (_quarter(k) + 2) * F.lit(1 << (8 * k))
    return cell


def _steps(radius: int) -> list[int]:
    """Differences between the cell numbers of cells that can hold a link, one of each pair of signs."""
    if radius > 2:
        raise ValueError("cells leave room for a radius of 2 at most")
    span = range(-radius, radius + 1)
    found = set()
    for d in ((a, b, c, e) for a in span for b in span for c in span for e in span):
        if sum(map(abs, d)) <= radius:
            found.add(sum(x * (1 << (8 * k)) for k, x in enumerate(d)))
    return sorted(x for x in found if x >= 0)


def _forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links that connect what the links within ``radius`` between two tiles connect."""
    n = len(left)
    size = n if same else n + len(right)
    label = np.arange(size)
    us, vs = [], []
    step = max(1, 2_000_000 // max(1, len(right)))
    for at in range(0, n, step):
        near = np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius
        u, v = np.nonzero(near)
        u = u + at
        if same:
            keep = u < v
            u, v = u[keep], v[keep]
        else:
            v = v + n
        if len(u):
            u, v = _thin(label, u, v)
            us.append(u)
            vs.append(v)
    if not us:
        return []
    return list(zip(np.concatenate(us).tolist(), np.concatenate(vs).tolist()))


def _thin(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (u, v), a spanning forest given the components so far in ``label``; updates them."""
    kept_u, kept_v = [], []
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, high))  # each root hangs under its least neighbour: no cycles
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        kept_u.append(u[first])
        kept_v.append(v[first])
        root = np.arange(len(label))
        root[high[first]] = low[first]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label[:] = root[label]
    if not kept_u:
        return u[:0], v[:0]
    return np.concatenate(kept_u), np.concatenate(kept_v)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``prints`` (fp long, distinct): links (a, b) that connect all fingerprints within ``radius`` bits."""
    cells = prints.select("fp", _cell().alias("cell"))
    # at most 17^4 cells whatever the input, 16 bytes each
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("_parts"))
    tiles = stored(
        cells.join(F.broadcast(parts), "cell")
        .withColumn("part", F.pmod(F.xxhash64("fp"), "_parts").cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = F.array(*[F.lit(x) for x in _steps(radius)])
    left = tiles.select(
        F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.col("fps").alias("fps_a"), F.explode(steps).alias("_d")
    ).withColumn("cell", F.col("cell_a") + F.col("_d"))
    pairs = (
        left.join(tiles, "cell")
        .where((F.col("_d") != 0) | (F.col("part_a") <= F.col("part")))
        .select("fps_a", "fps", ((F.col("_d") == 0) & (F.col("part_a") == F.col("part"))).alias("same"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, same in zip(batch["fps_a"], batch["fps"], batch["same"]):
                a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
                both = a if same else np.concatenate([a, b])
                links = _forest(a.view(np.uint64), b.view(np.uint64), radius, bool(same))
                found += [(int(both[u]), int(both[v])) for u, v in links]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (doc_id, text).

    A null or empty text, or one of white space, has the fingerprint zero, linked like any
    other. Repeated rows each get their row. ``component_id`` is the smallest ``doc_id``
    reachable over links; null ids get a row but never name a component, which is null
    where no member has an id. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(with_fingerprints(docs))
    prints = rows.groupBy("_fp").agg(F.min("doc_id").alias("_low")).withColumnRenamed("_fp", "fp")
    prints = stored(prints)
    comps = components(fingerprint_links(prints.select("fp"), radius))
    roots = prints.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "_low", F.coalesce("root", "fp").alias("_root")
    )
    lows = roots.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = roots.join(lows, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, "_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of its ``component_id``.

    Of rows that repeat that id one stays; of groups without any id, one row each. The columns are those of ``docs``.
    """
    columns = docs.columns
    kept = stored(numbered(docs))
    body = kept.select(F.col("_row").alias("doc_id"), "text")
    groups = near_duplicates(body, radius).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    member = kept.select("_row", F.col("doc_id").cast("long").alias("_id")).join(groups, "_row")
    best = member.groupBy("_group").agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("m")
    )
    return kept.join(best.select(F.col("m.r").alias("_row")), "_row", "left_semi").select(*[f"`{c}`" for c in columns])
