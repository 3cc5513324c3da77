"""Language identification by mixtures: what share of a document each language has.

A language is a smoothed distribution over hashed byte trigrams of lower-case letters. A
document is a mixture of languages and a flat background; expectation-maximisation finds
the shares from its trigram counts. Of the nested sets of its strongest languages, the one
with the largest likelihood less ``PENALTY`` times the logarithm of the trigram count for
each further language is kept, and the largest share names the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import bounded_batches, with_columns

BUCKETS = 1 << 14
#: The model goes to every task: ``BUCKETS`` numbers of 4 bytes for each language, so it is limited.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
#: Rounds of expectation-maximisation over all languages, and over each smaller set.
ROUNDS, SET_ROUNDS = 8, 5
#: A language with a smaller share among all can't repay its penalty and is not tried.
LEAST_SHARE = 0.005
#: Further languages that a document's set may hold.
SETS = 4
PENALTY = 2.0
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MIX = np.uint32(0x9E3779B1)
#: Documents and characters counted together; they bound the tables of a task, one text may be larger.
_TOGETHER, _CHARS = 64, 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts as buckets, and the number of the text of each."""
    raws = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" " for t in texts]
    sizes = np.array([len(r) for r in raws])
    flat = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(texts)), sizes)
    if len(flat) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
    keep = (of[:-2] == of[2:]) & (flat[1:-1] != 32)  # a space in the middle says nothing about either word
    return ((code[keep] * _MIX) >> np.uint32(18)).astype(np.int64), of[:-2][keep]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``_TOGETHER`` texts and ``_CHARS`` characters, at least one text each."""
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if i > low and (i - low == _TOGETHER or held + size > _CHARS):
            yield low, i
            low, held = i, 0
        held += size
    if sizes:
        yield low, len(sizes)


def fit(docs: DataFrame, lang: Column | None = None) -> dict[str, np.ndarray]:
    """Log distributions by language, from every row of ``docs`` (text, lang) with a letter and a language.

    Counts are summed on the executors; the driver gets at most ``BUCKETS`` rows a language.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), (F.col("lang") if lang is None else lang).cast("string").alias("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                texts = [t for t in texts if has_letter(t)]
                for low, high in _parts([len(t) for t in texts]):
                    found = np.bincount(_trigrams(texts[low:high])[0], minlength=BUCKETS)
                    sums[name] = sums[name] + found if name in sums else found
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": found[at]})

    counted = (
        bounded_batches(rows.where("text IS NOT NULL AND lang IS NOT NULL"))
        .mapInPandas(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    most = MAX_LANGUAGES * BUCKETS
    found = counted.limit(most + 1).toPandas()
    if len(found) > most or found["lang"].nunique() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    model = {}
    for name, part in found.groupby("lang"):
        counts = np.full(BUCKETS, SMOOTHING)
        counts[part["bucket"]] += part["n"]
        model[str(name)] = np.log(counts / counts.sum()).astype(np.float32)
    return model


def _shares(p: np.ndarray, n: np.ndarray, at: np.ndarray, of: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the columns of ``p`` in each text, and the log likelihood of each text.

    ``n``: how often each trigram occurs; ``at``: where texts begin; ``of``: the text of each trigram.
    """
    share, total = start, np.add.reduceat(n, at)[:, None]
    for _ in range(rounds):
        part = p * share[of]
        part *= (n / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, at, axis=0) / total
    fit_ = np.add.reduceat(n * np.log((p * share[of]).sum(axis=1)), at)
    return share, fit_


def mixtures(texts: list[str | None], names: list[str], tables: np.ndarray) -> list[list[tuple[str, float]]]:
    """For each text its languages with shares, the largest first; none for a text without letters.

    ``tables``: for each bucket its probability in each language and, last, in the background.
    """
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    told = [i for i, t in enumerate(texts) if has_letter(t)]
    if not names:
        return out
    for low, high in _parts([len(texts[i]) for i in told]):
        rows = told[low:high]
        codes, of = _trigrams([texts[i] for i in rows])
        counts = np.bincount(of * BUCKETS + codes, minlength=len(rows) * BUCKETS)
        cells = np.flatnonzero(counts)
        n, of, p = counts[cells].astype(np.float32), cells // BUCKETS, tables[cells % BUCKETS]
        at = np.searchsorted(of, np.arange(len(rows)))
        grams, sizes = np.add.reduceat(n, at), np.diff(np.r_[at, len(n)])
        width = len(names) + 1
        share, _ = _shares(p, n, at, of, np.full((len(rows), width), 1 / width, np.float32), ROUNDS)
        order = np.argsort(-share[:, :-1], axis=1, kind="stable")[:, : SETS + 1]
        ranked = np.concatenate([np.take_along_axis(p, order[of], axis=1), p[:, -1:]], axis=1)
        first = np.concatenate([np.take_along_axis(share, order, axis=1), share[:, -1:]], axis=1)
        best, chosen = np.full(len(rows), -np.inf), [first[r, :1] for r in range(len(rows))]
        for k in range(1, order.shape[1] + 1):
            some = np.flatnonzero(first[:, min(1, order.shape[1] - 1)] >= LEAST_SHARE) if k == 1 else some[first[some, k - 1] >= LEAST_SHARE]
            if not len(some):
                break
            cols = [*range(k), ranked.shape[1] - 1]
            begin = np.maximum(first[some][:, cols], 1e-4)
            mine = np.isin(of, some)
            at_ = np.cumsum(np.r_[0, sizes[some][:-1]])
            got, fit_ = _shares(
                ranked[mine][:, cols], n[mine], at_, np.repeat(np.arange(len(some)), sizes[some]), begin / begin.sum(axis=1, keepdims=True), SET_ROUNDS
            )
            worth = fit_ - PENALTY * (k - 1) * np.log(grams[some] + 1)
            for r, w, g in zip(some, worth, got):
                if w > best[r]:
                    best[r], chosen[r] = w, g[:k]
        for r, i in enumerate(rows):
            pairs = [(names[order[r, c]], float(min(1.0, s))) for c, s in enumerate(chosen[r])]
            out[i] = sorted(pairs, key=lambda x: (-x[1], x[0]))
    return out


def _tables(model: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = sorted(model)
    flat = np.full(BUCKETS, 1 / BUCKETS, np.float32)
    return names, np.stack([*(np.exp(model[x]) for x in names), flat], axis=1).astype(np.float32)


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default), lang_pred, score, langs, shares; one row per row.

    ``lang_pred`` is ``und`` with score 0 where the text is null, empty or has no letter, or
    where nothing was learned. ``score`` is the predicted language's share; ``langs`` and
    ``shares`` give the whole set. Only the text decides. Rows may repeat, ids may be null.
    """
    keep = ["doc_id"] if keep is None else keep
    names, tables = _tables(model)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))

    def tell(texts: list[str | None]) -> list[list]:
        found = mixtures(texts, names, tables)
        return [
            [x[0][0] if x else UNKNOWN for x in found],
            [x[0][1] if x else 0.0 for x in found],
            [[n for n, _ in x] for x in found],
            [[s for _, s in x] for x in found],
        ]

    out = with_columns(rows, "_text", {"lang_pred": "string", "score": "double", "langs": "array<string>", "shares": "array<double>"}, tell)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "langs", "shares")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are in no learned language (``und``); learned from their own ``lang``.

    Null and empty texts and those without a letter go; where no row has a language, nothing
    else does. Repeated rows and further columns stay as they are; an empty table stays empty.
    """
    model = fit(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    if not model:
        letters = lambda texts: [[has_letter(t) for t in texts]]
        told = with_columns(plain.withColumn("_text", F.col(at["text"]).cast("string")), "_text", {"_told": "boolean"}, letters)
        return told.where("_told").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    told = identify(plain.withColumn("text", F.col(at["text"])), model, names)
    return told.where(F.col("lang_pred") != UNKNOWN).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
