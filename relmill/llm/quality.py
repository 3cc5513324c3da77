"""Quality selection by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs are counted: one of the target
(documents labelled as good), one of the raw corpus. A document's log weight is the log
ratio of the two, and adding Gumbel noise to it and taking the largest ``k`` samples ``k``
documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import WordCodes, bare, bounded_batches, stored, with_columns, word_hash

BUCKETS = 10_000
SMOOTHING = 0.01
#: The target model is counted over at most so many labelled documents, those with the smallest hashes.
FIT_DOCS = 20_000
#: Share of the documents to sample.
SHARE = 0.5
SEED = 8
_PAIR = np.uint64(0x9E3779B97F4A7C15)

_codes: list[WordCodes] = []


def grams(text: str | None) -> np.ndarray:
    """The buckets of a text's words and word pairs, repeats included."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    if not _codes:
        _codes.append(WordCodes(lambda w: word_hash(bare(w) or w)))
    codes = _codes[0].array(words).view(np.uint64)
    pairs = (codes[:-1] * _PAIR ^ codes[1:]) * _PAIR >> np.uint64(20)
    return np.concatenate([codes % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64)


def _counts(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over all rows; the driver gets at most ``BUCKETS`` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    rows = bounded_batches(texts.where("text IS NOT NULL")).mapInPandas(count, "bucket int, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[found["bucket"]] = found["n"]
    return out


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log of target over raw probability by bucket.

    ``docs`` (doc_id, text) is counted whole; ``target`` (doc_id) names the good documents,
    of which ``FIT_DOCS`` at most are counted. Without any the ratio is 1 everywhere.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    some = ids.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(FIT_DOCS)
    good = _counts(texts.join(F.broadcast(some), "doc_id").select("text"))  # FIT_DOCS numbers of 8 bytes
    if not good.any():
        return np.zeros(BUCKETS)
    raw = _counts(texts.select("text"))
    good, raw = good + SMOOTHING, raw + SMOOTHING
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id and the seed only."""
    unit = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key), one row per row of ``docs``; an empty or null text weighs 1 (log 0)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = np.asarray(ratio, np.float64)

    def tell(texts: list[str | None]) -> list[list]:
        found = [grams(t) for t in texts]
        return [[len(g) for g in found], [float(ratio[g].sum()) for g in found]]

    out = with_columns(rows, "text", {"n_grams": "long", "log_weight": "double"}, tell)
    return out.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))


#: Cells into which the range of keys is cut in one round of the search for the k-th.
CELLS = 4096


def kth_largest(rows: DataFrame, k: int) -> float | None:
    """The ``k``-th largest ``key``; None if there are fewer rows. Each round brings at most ``CELLS`` counts to the driver."""
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    left = k
    while low < high:
        step = (high - low) / CELLS
        if not step or low + step == low or high - step == high:  # neighbouring numbers
            keys = rows.where(F.col("key").between(low, high)).groupBy("key").count().orderBy(F.desc("key")).collect()
            for key, times in keys:
                if times >= left:
                    return key
                left -= times
        cell = F.least(F.floor((F.col("key") - low) / step), F.lit(CELLS - 1))
        parts = (
            rows.where(F.col("key").between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        )
        for row in sorted(parts.collect(), key=lambda r: -r.c):
            if row.n >= left:
                low, high = row.a, row.b
                break
            left -= row.n
    return low


def resample(weighed: DataFrame, k: int) -> DataFrame:
    """``weighed`` with ``selected``: whether a row is among the ``k`` with the largest ``key``.

    Of rows with the same key at the border, those with the smaller ids are taken; equal
    rows (same id, same key) at the border are all taken or none.
    """
    n = weighed.count()
    if k >= n:
        return weighed.withColumn("selected", F.lit(True))
    border = kth_largest(weighed, k)
    if border is None:
        return weighed.withColumn("selected", F.lit(False))
    above = weighed.where(F.col("key") > border).count()
    ties = weighed.where(F.col("key") == border)
    last = ties.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("doc_id")).limit(max(1, k - above)).collect()
    room, ids = k - above, []
    for doc, times in last:
        if times > room:
            break
        ids.append(doc)
        room -= times
    ids_in = F.lit(False)
    if ids:
        known = [i for i in ids if i is not None]
        ids_in = (F.col("doc_id") <= max(known)) if known else F.lit(False)
        if None in ids:
            ids_in = F.coalesce(ids_in, F.lit(True))
    return weighed.withColumn("selected", (F.col("key") > border) | ((F.col("key") == border) & F.coalesce(ids_in, F.lit(False))))


def select_by_importance(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, selected), one row per row of ``docs`` (doc_id, text).

    ``share`` of the rows is sampled, rounded down. Ids may repeat or be null, texts be null
    or empty; other columns are ignored; an empty table gives no rows.
    """
    weighed = stored(weigh(docs, fit(docs, target), seed))
    return resample(weighed, int(weighed.count() * share))
