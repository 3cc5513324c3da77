"""Personal data: fixed patterns, and a semi-Markov conditional random field for their variants.

The patterns give the base spans. The field looks at what they left: it cuts the text
around digits and at signs into atoms and scores every segment of up to ``LONGEST`` atoms
as a whole (how many digits, which separators, a check digit, what stands around it) for
each kind. A Viterbi pass over boundaries and kinds together, with that bound on a
segment's length, adds the spans it prefers to "no entity". Base spans stay as they are.

It is trained on the base spans of a bounded sample, both as written and rewritten into
variants the patterns miss (a phone number without its plus sign, a card number with dots);
everything around them teaches what is none.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relmill.llm.common import with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

#: Atoms in a segment at most. A 19-digit card number with `` . `` between its groups, the longest variant, has 17.
LONGEST = 20
#: The fit reads the documents with the smallest hashes, at most so many, and so many zones of them.
FIT_DOCS, FIT_ZONES = 4000, 400
EPOCHS, RATE = 6, 0.3
#: What a segment must gain over "no entity".
MARGIN = 2.0

# ---- fixed values: the base patterns ----
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# ---- end of fixed values ----


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans by kind and start. Linear in the text, whatever it holds."""
    out: list[Span] = []
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # no address reaches over an at sign
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---- segments ----

_ATOM = re.compile(r"[0-9]{1,19}|[^\W0-9_]{1,40}|\s|.", re.S)
_ANCHOR = re.compile(r"[0-9]{2,}|@")
_REACH = 48  # characters around an anchor that belong to its zone

_CLASSES = ("digits", "letters", "space", "dot", "dash", "open", "close", "plus", "at", "other")
_CLASS_OF = {".": 3, "-": 4, "(": 5, ")": 6, "+": 7, "@": 8}


def _class(atom: str) -> int:
    c = atom[0]
    if "0" <= c <= "9":
        return 0
    if c.isalpha():
        return 1
    return 2 if c.isspace() else _CLASS_OF.get(c, 9)


_DIGIT_STEPS = np.array([1, 4, 7, 8, 9, 10, 11, 12, 14, 16, 17, 20])
_RUN_STEPS = np.array([1, 2, 3, 4, 5, 6])
N_FEATURES = 1 + (len(_DIGIT_STEPS) + 1) + (len(_RUN_STEPS) + 1) + 4 * 6 + 2 * len(_CLASSES) + 2 * (len(_CLASSES) + 1) + 8


class Zone:
    """Atoms of a stretch of text, and the features of all its segments."""

    def __init__(self, text: str) -> None:
        self.starts, kinds, digits, runs_over = [], [], [], []
        for m in _ATOM.finditer(text):
            self.starts.append(m.start())
            k = _class(m.group())
            kinds.append(k)
            digits.append(m.group() if k == 0 else "")
            runs_over.append(k == 0 and (len(m.group()) > 3 or int(m.group()) > 255))
        self.starts.append(len(text))
        self.n = n = len(kinds)
        kinds = np.array(kinds, np.int64)
        width = min(LONGEST, n)
        i = np.repeat(np.arange(n), width)
        j = i + np.tile(np.arange(1, width + 1), n)
        ok = j <= n
        self.i, self.j = i, j = i[ok], j[ok]
        counts = np.zeros((n + 1, len(_CLASSES)), np.int64)
        np.add.at(counts, (np.arange(1, n + 1), kinds), 1)
        counts = counts.cumsum(0)
        of = counts[j] - counts[i]
        sizes = np.r_[0, np.cumsum([len(d) for d in digits])]
        n_digits = sizes[j] - sizes[i]
        row = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - 48
        twice = np.where(row > 4, 2 * row - 9, 2 * row)
        even = np.arange(len(row)) % 2 == 0
        sums = [np.r_[0, np.cumsum(np.where(e, x, 0))] for x in (row, twice) for e in (even, ~even)]
        part = [s[sizes[j]] - s[sizes[i]] for s in sums]
        last_even = (sizes[j] - 1) % 2 == 0
        check = np.where(last_even, part[0] + part[3], part[1] + part[2]) % 10 == 0
        over = np.r_[0, np.cumsum(runs_over)]
        around = np.r_[len(_CLASSES), kinds, len(_CLASSES)]
        first, last, before, behind = kinds[i], kinds[j - 1], around[i], around[j + 1]
        cols = [np.ones(len(i), bool)]
        cols += [np.searchsorted(_DIGIT_STEPS, n_digits, side="right") == k for k in range(len(_DIGIT_STEPS) + 1)]
        cols += [np.searchsorted(_RUN_STEPS, of[:, 0], side="right") == k for k in range(len(_RUN_STEPS) + 1)]
        for c in (1, 2, 3, 4, 8, 9):
            cols += [of[:, c] == 0, of[:, c] == 1, of[:, c] == 3, (of[:, c] > 1) & (of[:, c] != 3)]
        cols += [first == k for k in range(len(_CLASSES))] + [last == k for k in range(len(_CLASSES))]
        cols += [before == k for k in range(len(_CLASSES) + 1)] + [behind == k for k in range(len(_CLASSES) + 1)]
        long_card = (n_digits >= 16) & (n_digits <= 19)
        cols += [
            long_card & check & (of[:, 1] == 0), long_card & ~check,
            (of[:, 0] == 4) & (over[j] == over[i]), over[j] > over[i],
            (of[:, 5] == of[:, 6]) & (of[:, 5] > 0), of[:, 5] != of[:, 6],
            (of[:, 8] == 1) & (of[:, 3] > 0) & (of[:, 2] == 0), (before <= 1) & (first <= 1) | (behind <= 1) & (last <= 1),
        ]
        self.x = np.stack(cols, axis=1).astype(np.float32)

    def segment(self, start: int, end: int) -> int | None:
        """The number of the segment with this span."""
        try:
            i, j = self.starts.index(start), self.starts.index(end)
        except ValueError:
            return None
        hit = np.flatnonzero((self.i == i) & (self.j == j))
        return int(hit[0]) if len(hit) else None


def _forward(n: int, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Log of the summed weights of all ways to cut the first k atoms; single atoms outside score 0."""
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0.0
    order = np.argsort(j, kind="stable")
    at = np.searchsorted(j[order], np.arange(n + 2))
    for k in range(1, n + 1):
        s = order[at[k] : at[k + 1]]
        terms = np.r_[alpha[k - 1], alpha[i[s]] + scores[s]]
        top = terms.max()
        alpha[k] = top + np.log(np.exp(terms - top).sum())
    return alpha


def fit_zones(zones: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = 1) -> np.ndarray | None:
    """Weights (features by kinds) that make the given spans likely; None without any span."""
    data = []
    for text, spans in zones:
        z = Zone(text)
        gold = [(z.segment(a, b), k) for k, a, b in spans]
        if z.n and all(s is not None for s, _ in gold):
            data.append((z, gold))
    if not any(gold for _, gold in data):
        return None
    w = np.zeros((N_FEATURES, len(KINDS)))
    w[0] = -2.0
    squares = np.full_like(w, 1e-3)
    rnd = random.Random(seed)
    for _ in range(epochs):
        rnd.shuffle(data)
        for z, gold in data:
            each = z.x @ w
            top = each.max(axis=1)
            both = top + np.log(np.exp(each - top[:, None]).sum(axis=1))
            alpha = _forward(z.n, z.i, z.j, both)
            beta = _forward(z.n, z.n - z.j, z.n - z.i, both)[::-1]
            chance = np.exp(np.minimum(0, alpha[z.i] + both + beta[z.j] - alpha[-1]))
            expected = np.exp(each - both[:, None]) * chance[:, None]
            grad = -(z.x.T @ expected) - 1e-3 * w
            for s, k in gold:
                grad[:, k] += z.x[s]
            squares += grad**2
            w += RATE * grad / np.sqrt(squares)
    return w


#: Atoms whose segments are scored at once; bounds the memory of a long zone.
_BLOCK = 512


def best_segments(text: str, weights: np.ndarray) -> list[Span]:
    """The best cut of a zone into entities and single atoms outside, by Viterbi.

    Segments are scored block by block. A block also holds the ``LONGEST`` atoms and one before it and the
    one behind it, so that every segment is seen whole and with its surroundings: the cut is that of the whole zone.
    """
    edges = [m.start() for m in _ATOM.finditer(text)] + [len(text)]
    n = len(edges) - 1
    best, back, kinds = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    for low in range(0, n, _BLOCK):
        high = min(n, low + _BLOCK)
        first = max(0, low - LONGEST - 1)
        z = Zone(text[edges[first] : edges[min(n, high + 1)]])
        each = z.x @ weights
        kind, score = each.argmax(axis=1), each.max(axis=1) - MARGIN
        end = z.j + first
        good = np.flatnonzero((score > 0) & (end > low) & (end <= high))
        by_end: dict[int, list[tuple[int, float, int]]] = {}
        for i, j, x, k in zip((z.i[good] + first).tolist(), end[good].tolist(), score[good].tolist(), kind[good].tolist()):
            by_end.setdefault(j, []).append((i, x, k))
        for at in range(low + 1, high + 1):
            best[at] = best[at - 1]
            for i, x, k in by_end.get(at, ()):
                if best[i] + x > best[at]:
                    best[at], back[at], kinds[at] = best[i] + x, i, k
    out, at = [], n
    while at:
        if back[at] < 0:
            at -= 1
        else:
            out.append((kinds[at], edges[back[at]], edges[at]))
            at = back[at]
    return out[::-1]


def zones_of(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Stretches around digits and at signs outside the ``taken`` spans; they don't overlap these or each other.

    A stretch ends at a taken span or where no anchor follows within reach of the last, however long that makes it.
    """
    walls: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in taken):
        if walls and a <= walls[-1][1]:
            walls[-1] = (walls[-1][0], max(b, walls[-1][1]))
        else:
            walls.append((a, b))
    out: list[list[int]] = []
    w = 0
    for m in _ANCHOR.finditer(text):
        while w < len(walls) and walls[w][1] <= m.start():
            w += 1
        if w < len(walls) and walls[w][0] < m.end():
            continue
        low = max(0, m.start() - _REACH, walls[w - 1][1] if w else 0)
        high = min(len(text), m.end() + _REACH, walls[w][0] if w < len(walls) else len(text))
        if out and low <= out[-1][1] and (not w or walls[w - 1][1] <= out[-1][0]):
            out[-1][1] = high
        else:
            out.append([max(low, out[-1][1]) if out else low, high])
    return [(a, b) for a, b in out if a < b]


def all_spans(text: str, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those that the field adds."""
    base = base_spans(text)
    if weights is None:
        return base, []
    added = [(k, low + a, low + b) for low, high in zones_of(text, base) for k, a, b in best_segments(text[low:high], weights)]
    return base, sorted(added)


# ---- training ----


def variants(kind: int, span: str, rnd: random.Random) -> str:
    """A span as it is, or rewritten so that its pattern misses it."""
    if rnd.random() < 0.5:
        return span
    if kind == 0:
        return span.replace("@", rnd.choice([" @ ", " @", "@ "]))
    if kind == 1:
        return span.replace(".", rnd.choice(["-", ". "]))
    if kind == 2:
        digits = re.sub(r"\D", "", span)
        return rnd.choice([".", "  ", " . "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = re.sub(r"\D", "", span)
    area, rest = digits[-10:-4], digits[-4:]
    return rnd.choice([f"({area[:3]}) {area[3:]}-{rest}", f"{area[:3]}-{area[3:]}-{rest}", f"{area[:3]}.{area[3:]}.{rest}", span.lstrip("+")])


def training_zones(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """Zones of a text with their spans, each written in one of its variants."""
    rnd = random.Random(seed)
    base = sorted(base_spans(text), key=lambda s: (s[1], s[2]))
    out, end = [], 0
    for n, (k, a, b) in enumerate(base):
        if a < end or (n + 1 < len(base) and base[n + 1][1] < b):
            end = max(end, b)
            continue
        end = b
        low = max(a - _REACH, base[n - 1][2] if n else 0, 0)
        high = min(b + _REACH, base[n + 1][1] if n + 1 < len(base) else len(text), len(text))
        span = variants(k, text[a:b], rnd)
        out.append((text[low:a] + span + text[b:high], [(k, a - low, a - low + len(span))]))
    return out + [(text[a:b], []) for a, b in zones_of(text, base)[:3]]


def fit(docs: DataFrame) -> np.ndarray | None:
    """Learns from the ``FIT_DOCS`` rows of ``docs`` (text) whose texts have the smallest hashes.

    Repeated texts teach once. Of their zones, those with the smallest hashes come to the driver: a fifth of
    ``FIT_ZONES`` for each kind, a third for stretches without any. None where no text holds a base span.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    dice = F.xxhash64("text", F.lit(6))
    sample = texts.select(dice.alias("_d")).orderBy("_d").limit(FIT_DOCS).distinct()
    chosen = texts.withColumn("_d", dice).join(F.broadcast(sample), "_d")  # FIT_DOCS numbers of 8 bytes
    once = chosen.groupBy("_d").agg(F.min("text").alias("text"))

    def cut(values: list[str]) -> list[list]:
        return [[[json.dumps(z) for z in training_zones(v, len(v))] for v in values]]

    zones = with_columns(once, "text", {"zones": "array<string>"}, cut).select(F.explode("zones").alias("zone")).distinct()
    kind = F.coalesce(F.get_json_object("zone", "$[1][0][0]").cast("int"), F.lit(len(KINDS)))
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("_z", "zone"))
    few = zones.select("zone", kind.alias("kind"), F.xxhash64("zone").alias("_z")).withColumn("turn", turn)
    few = few.where(F.col("turn") <= F.when(F.col("kind") < len(KINDS), FIT_ZONES // 5).otherwise(FIT_ZONES // 3))
    found = few.where(F.col("turn") <= FIT_ZONES).select("kind", "turn", "zone").collect()  # FIT_ZONES a kind at most
    return fit_zones([(text, [tuple(s) for s in spans]) for text, spans in (json.loads(r.zone) for r in sorted(found))])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, weights: np.ndarray | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default), n_email, n_ip, n_card, n_phone, n_added, base, spans.

    One row per row of ``docs``. The counts are of base spans; ``n_added`` counts the field's.
    ``base`` and ``spans`` hold kind:start:end by kind and start, comma-joined, in code
    points, end exclusive. A null text counts as empty and has none. Ids may repeat or be null.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    fields = {**{f"n_{k}": "long" for k in KINDS}, "n_added": "long", "base": "string", "spans": "string"}

    def tell(texts: list[str | None]) -> list[list]:
        out = []
        for text in texts:
            base, added = all_spans(text or "", weights)
            counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
            out.append((*counts, len(added), joined(base), joined(base + added)))
        return list(zip(*out)) if out else [[]] * len(fields)

    out = with_columns(rows, "_text", fields, tell)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *fields)


def redacted(text: str, weights: np.ndarray | None) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go as one, named after the first."""
    base, added = all_spans(text, weights)
    out, end = [], 0
    merged: list[list[int]] = []
    for k, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[end:a], f"<{KINDS[k]}>"]
        end = b
    return "".join(out) + text[end:]


def redact(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null. The columns are those of ``docs``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))

    def clean(texts: list[str | None]) -> list[list]:
        return [[None if t is None else redacted(t, weights) for t in texts]]

    out = with_columns(docs.toDF(*names).withColumn(at["text"], F.col(at["text"]).cast("string")), at["text"], {"_clean": "string"}, clean)
    return out.select(*[(F.col("_clean") if c == "text" else F.col(at[c])).alias(c) for c in docs.columns])
