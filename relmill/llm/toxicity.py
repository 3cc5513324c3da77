"""Toxic documents by multiple-instance learning.

Labels are on documents, offences are in sentences. A sentence's score is logistic in
the words and word beginnings it holds, with weights of zero or more: words can accuse a
sentence, none can excuse it. A document's score is the noisy-or of its sentences:
1 - prod(1 - s), s being what a sentence scores above one without any evidence. Training follows the document labels through that formula, so the weight goes to the sentences that
explain a label, and afterwards the model points at them.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import WordCodes, bare, with_columns

#: The fit reads at most so many labelled documents of each class, of at most so many characters.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 1500, 3500, 20_000
#: A feature occurs in so many documents of the sample at least, and so much more often in toxic ones.
LEAST_DOCS, LEAST_LIFT = 4, 4.0
STEPS, RATE, SHRINK = 150, 0.2, 2e-4
THRESHOLD = 0.7

_ENDS = (".", "!", "?", "…", ".\"", "!\"", "?\"", ".)", "!)", "?)")
_SPAN = re.compile(r"\S+")


@dataclass
class Model:
    """Weights of words and word beginnings, and the logit of a sentence without any."""

    weights: dict[str, float]
    bias: float


EMPTY = Model({}, -30.0)


def features(word: str) -> list[str]:
    """A word, and its first 3, 4 and 5 letters."""
    word = bare(word)
    return ["=" + word, *(f"{k}{word[:k]}" for k in (3, 4, 5) if len(word) >= k)] if word else []


def _sentences(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and where a line's words start in them."""
    words: list[str] = []
    starts = []
    for line in text.split("\n"):
        found = line.split()
        if found:
            starts.append(len(words))
            words += found
    return words, starts


class _Lookup:
    """From words to their weight, as a whole number of millionths with the lowest bit set where a sentence ends."""

    def __init__(self, model: Model) -> None:
        weights = model.weights
        self.codes = WordCodes(lambda w: 2 * round(1e6 * sum(weights.get(f, 0.0) for f in features(w))) + w.endswith(_ENDS))
        self.bias = model.bias

    def sentence_logits(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Logit and first word of each sentence; how many words there are."""
        words, starts = _sentences(text)
        if not words:
            return np.empty(0), np.empty(0, np.int64), 0
        codes = self.codes.array(words)
        first = np.union1d(np.asarray(starts), np.flatnonzero(codes & 1) + 1)
        first = first[first < len(words)]
        return np.add.reduceat(codes >> 1, first) / 1e6 + self.bias, first, len(words)


def noisy_or(logits: np.ndarray, bias: float) -> float:
    """1 - prod(1 - s) over sentences, with s = (p - p0) / (1 - p0): the logistic score p of a
    sentence above p0, that of one without any feature. So a text does not turn toxic by its length."""
    some = logits[logits > bias]
    return float(-np.expm1(-(np.logaddexp(0, some) - np.logaddexp(0, bias)).sum())) if len(some) else 0.0


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, steps: int = STEPS) -> Model:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) that satisfy ``where`` (on doc_id).

    Of labelled ids, the first ``FIT_TOXIC`` and ``FIT_CLEAN`` in the order of a hash take
    part; texts above ``FIT_CHARS`` don't. A repeated label counts as toxic if one is. The
    driver receives these texts only.
    """
    told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    told = told if where is None else told.where(where)
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    dice = F.xxhash64("doc_id", F.lit(9))
    sample = told.where("_toxic = 1").orderBy(dice).limit(FIT_TOXIC).unionByName(told.where("_toxic = 0").orderBy(dice).limit(FIT_CLEAN))

    # at most FIT_TOXIC + FIT_CLEAN ids of 12 bytes
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= FIT_CHARS)
    found = chosen.join(F.broadcast(sample), "doc_id").select("text", "_toxic").toPandas()
    return train(found["text"].tolist(), found["_toxic"].tolist(), steps)


def train(texts: list[str], toxic: list[int], steps: int = STEPS) -> Model:
    """Follows the likelihood of the labels by gradient steps; the same model however the rows are ordered."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], toxic[i]))
    is_toxic = np.array([toxic[i] for i in order], bool)
    if not len(order) or is_toxic.all() or not is_toxic.any():
        return EMPTY
    numbers: dict[str, int] = {}
    word, sentence, of = array("q"), array("q"), array("q")  # of: the document of each sentence
    for d, i in enumerate(order):
        words, starts = _sentences(texts[i])
        begins = set(starts)
        for k, w in enumerate(words):
            if k in begins or words[k - 1].endswith(_ENDS):
                of.append(d)
            word.append(numbers.setdefault(w, len(numbers)))
            sentence.append(len(of) - 1)
    word, sentence, of = (np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64) for x in (word, sentence, of))
    if not len(word):
        return EMPTY
    names: dict[str, int] = {}
    at_word, at_feature = [], []
    for w, k in numbers.items():
        for f in features(w):
            at_word.append(k)
            at_feature.append(names.setdefault(f, len(names)))
    at_word, at_feature = np.array(at_word, np.int64), np.array(at_feature, np.int64)
    # documents with each feature, by label
    both = np.unique(of[sentence] * len(numbers) + word)
    doc, held = both // len(numbers), both % len(numbers)
    begin = np.searchsorted(at_word, np.arange(len(numbers) + 1))
    times = np.diff(begin)[held]
    feature = at_feature[np.repeat(begin[held], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    seen = np.unique(np.repeat(doc, times) * len(names) + feature)
    bad = np.bincount(seen % len(names), is_toxic[seen // len(names)], len(names))
    good = np.bincount(seen % len(names), ~is_toxic[seen // len(names)], len(names))
    lift = (bad + 0.5) / (is_toxic.sum() + 1) * ((~is_toxic).sum() + 1) / (good + 0.5)
    useful = (bad + good >= LEAST_DOCS) & (lift >= LEAST_LIFT)
    number = np.cumsum(useful) - 1
    keep = useful[at_feature]
    at_word, at_feature, n = at_word[keep], number[at_feature[keep]], int(useful.sum())
    w, b = np.zeros(n), -5.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    matters = np.isin(word, at_word)
    word, sentence = word[matters], sentence[matters]
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, np.bincount(at_word, w[at_feature], len(numbers))[word], len(of))
        a = np.bincount(of, np.logaddexp(0, z) - np.logaddexp(0, b), len(order))  # the document's score is 1 - exp(-a)
        pull = np.where(is_toxic, -1 / np.expm1(np.clip(a, 1e-3, 500)), 1.0) / len(order)
        dz = pull[of] * np.exp(-np.logaddexp(0, -z))
        db = dz - pull[of] * np.exp(-np.logaddexp(0, -b))
        by_word = np.bincount(word, dz[sentence], len(numbers))
        grad = np.r_[np.bincount(at_feature, by_word[at_word], n) + SHRINK, db.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    listed = np.array(list(names), object)[useful]
    return Model({str(f): float(x) for f, x in zip(listed, w) if x > 1e-3}, float(b))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default), score, predicted, n_sentences, n_offending, worst_start, worst_end.

    One row per row of ``docs``. A null or empty text has score 0 and no worst sentence. A
    sentence offends if its own score reaches ``threshold``. Spans are in code points, end
    exclusive. Only the text decides.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    least = float(np.log(threshold / (1 - threshold)))

    def tell(texts: list[str | None]) -> list[list]:
        of = _lookup(model)
        out = []
        for text in texts:
            logits, first, n = of.sentence_logits(text or "")
            if not len(logits):
                out.append((0.0, 0, 0, 0, None, None))
                continue
            worst = int(np.argmax(logits))
            start, end = _span(text, int(first[worst]), int(first[worst + 1]) if worst + 1 < len(first) else n)
            p = noisy_or(logits, of.bias)
            out.append((p, int(p >= threshold), len(logits), int((logits >= least).sum()), start, end))
        return list(zip(*out)) if out else [[]] * 6

    fields = {"score": "double", "predicted": "int", "n_sentences": "int", "n_offending": "int", "worst_start": "int", "worst_end": "int"}
    out = with_columns(rows, "_text", fields, tell)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *fields)


def _span(text: str, first: int, end: int) -> tuple[int, int]:
    start = stop = 0
    for i, m in enumerate(_SPAN.finditer(text)):
        if i == first:
            start = m.start()
        stop = m.end()
        if i == end - 1:
            break
    return start, stop


_cached: list[tuple[str, _Lookup]] = []


def _lookup(model: Model) -> _Lookup:
    """The worker's lookup for a model; built once for all batches of a task."""
    key = repr((sorted(model.weights.items()), model.bias))
    if not _cached or _cached[0][0] != key:
        _cached[:] = [(key, _Lookup(model))]
    return _cached[0][1]


def offending_sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, score, sentence): the sentences of ``docs`` whose own score reaches ``threshold``."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def find(texts: list[str | None]) -> list[list]:
        of = _lookup(model)
        out: list[list[list]] = [[], [], []]
        for text in texts:
            logits, first, n = of.sentence_logits(text or "")
            ends = np.r_[first[1:], n]
            hits = np.flatnonzero(logits >= np.log(threshold / (1 - threshold)))
            spans = [_span(text, int(first[h]), int(ends[h])) for h in hits]
            for cell, got in zip(out, ([a for a, _ in spans], [b for _, b in spans], [float(1 / (1 + np.exp(-logits[h]))) for h in hits])):
                cell.append(got)
        return out

    made = with_columns(rows, "text", {"_a": "array<int>", "_b": "array<int>", "_s": "array<double>"}, find, drop=False)
    flat = made.select("doc_id", "text", F.explode(F.arrays_zip("_a", "_b", "_s")).alias("_x"))
    a, b = F.col("_x._a"), F.col("_x._b")
    return flat.select("doc_id", a.alias("start"), b.alias("end"), F.col("_x._s").alias("score"), F.substring("text", a + 1, b - a).alias("sentence"))
