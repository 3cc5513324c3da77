"""Byte-level BPE encoding and decoding of whole texts, exactly as the tokenizer file says.

Short texts are encoded at once. A text above ``LONG`` characters is halved again and again,
wherever the middle falls; the pieces are encoded by different tasks and joined pairwise.
At a join both neighbours were encoded without seeing each other, so a window around it is
encoded again and grown until it agrees with the left piece at a place before the join and
with the right piece at a place behind it. Two encodings agree at a place if

* both start a pre-token there (the splitting pattern has no memory, so both go on alike), or
* both are inside one pre-token there and have the same token before it. Every pair of
  neighbouring tokens of the joined row then occurs in an encoding of real text, which for
  BPE with ranked merges makes the whole row the encoding of the whole pre-token.

If they never agree, the window grows to the whole of both pieces, so the result is exact.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import numbered, with_columns

#: Texts of more characters are halved, down to pieces of at most half as many.
LONG = 32_768
#: First reach of a window to either side, in bytes.
REACH = 64
#: The splitting pattern looks at most three characters ahead.
AHEAD = 16

_CUT = re.compile(r"(?<=[^\s᠎​﻿]) (?=[^\s᠎​﻿])")
#: White space (to any reader of the pattern) besides the space and the line end.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u200b\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_CLOSERS = frozenset(".,;:!?)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or 256 and on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Bounded cache from a stretch of text to its ids, as little-endian unsigned 32-bit integers: bytes are joined in one go."""

    def __init__(self, codec: Codec, before: str, limit: int = 300_000) -> None:
        super().__init__()
        self.codec, self.before, self.limit = codec, before, limit

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            ids = self.codec.letters(self.before, piece)
        elif piece[-1:] in _CLOSERS and piece[:-1].isalpha():
            ids = self[piece[:-1]] + self.codec.heads[piece[-1]]
        else:
            ids = self.codec.direct(self.before + piece)
        if len(piece) <= 64 and len(self) < self.limit:  # full: what came first holds the frequent ones
            self[piece] = ids
        return ids


class Codec:
    """A byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        if (
            pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or not pre.get("use_regex", True)
            or said.get("normalizer")
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"])
        ):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        names = _byte_names()
        self.bytes_of: dict[int, bytes] = {
            i: bytes(names[c] for c in piece) for piece, i in said["model"]["vocab"].items() if set(piece) <= names.keys()
        }
        specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in specials.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.special_ids = specials
        size = max(self.bytes_of) + 1
        self.length = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.names = {b: c for c, b in names.items()}
        self.plain = not any(s.strip().isalpha() for s in specials)
        self.heads, self.words = _Pieces(self, ""), _Pieces(self, " ")

    def direct(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def letters(self, before: str, text: str) -> bytes:
        """Ids of letters after ``before``, at most one space, which are one pre-token."""
        if not self.plain:  # a special token may be all letters
            return self.direct(before + text)
        # ASCII letters stand for themselves
        named = text if text.isascii() else "".join(map(self.names.__getitem__, text.encode()))
        ids = [t.id for t in self.tok.model.tokenize(self.names[32] + named if before else named)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. It is cut before single spaces between words and around single
        line ends, where a pre-token always starts; repeated stretches are looked up."""
        if not text:
            return np.empty(0, np.uint32)
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or any(c in text for c in _ODD):
            lines = [_CUT.split(text)]
        else:
            lines = [line.split(" ") for line in text.split("\n")]
        heads, words, parts = self.heads, self.words, []
        for at, line in enumerate(lines):
            if at:
                parts.append(heads["\n"])
            parts.append(heads[line[0]])
            parts.extend(map(words.__getitem__, line[1:]))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        return self.raw(ids).decode("utf-8", "replace")

    def raw(self, ids: np.ndarray) -> bytes:
        known = self.bytes_of
        try:
            return b"".join(map(known.__getitem__, ids.tolist()))
        except KeyError:
            return b"".join(known.get(i, b"") for i in ids.tolist())

    def starts(self, text: str) -> np.ndarray:
        """Byte offsets at which the pre-tokens of a text without special tokens start."""
        sizes = [len(name) for name, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]  # one letter a byte
        return np.cumsum([0, *sizes[:-1]]) if sizes else np.empty(0, np.int64)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@dataclass
class Piece:
    """A stretch of text without special tokens, and its ids."""

    raw: bytes
    ids: np.ndarray


def _char_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _safe_start(raw: bytes, at: int, reach: int) -> int:
    """A place at or before ``at`` from which the splitting pattern can be followed."""
    low = _char_start(raw, max(0, at - 4 * reach))
    cuts = list(_CUT.finditer(raw[low : at + 1].decode("utf-8", "ignore")))
    if not cuts:
        return 0
    return low + len(raw[low : at + 1].decode("utf-8", "ignore")[: cuts[-1].start()].encode())


def _run_before(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of the pre-token that holds each place lie before it; 0 at a start."""
    return at - starts[np.searchsorted(starts, at, side="right") - 1]


def _agree(
    ends_a: np.ndarray, ids_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray, ids_b: np.ndarray, starts_b: np.ndarray,
    low: int, high: int,
) -> np.ndarray:
    """Places above ``low`` and up to ``high`` at which two encodings agree."""
    both, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    inside = (both > low) & (both <= high)
    both, at_a, at_b = both[inside], at_a[inside], at_b[inside]
    if not len(both):
        return both
    run_a, run_b = _run_before(starts_a, both), _run_before(starts_b, both)
    start = (run_a == 0) & (run_b == 0)
    within = (run_a > 3) & (run_b > 3) & (ids_a[at_a] == ids_b[at_b])  # longer than any contraction
    return both[start | within]


def join(codec: Codec, left: Piece, right: Piece, reach: int = REACH) -> Piece:
    """The encoding of two neighbouring pieces as one text."""
    if not left.raw or not right.raw:
        return left if left.raw else right
    cut, raw = len(left.raw), left.raw + right.raw
    ends_l = np.cumsum(codec.length[left.ids])
    ends_r = np.cumsum(codec.length[right.ids]) + cut
    while True:
        a = _char_start(raw, max(0, cut - reach))
        b = len(raw) if cut + reach >= len(raw) else _char_start(raw, cut + reach)
        window = raw[a:b].decode()
        ids = codec.encode(window)
        ends, starts = np.cumsum(codec.length[ids]) + a, codec.starts(window) + a
        p, q = (0, len(raw)) if a == 0 and b == len(raw) else (None, None)
        if a == 0:
            p = 0
        else:
            safe = _safe_start(raw, a, reach)
            tail = np.searchsorted(ends_l, safe, side="right")
            found = _agree(
                ends_l[tail:], left.ids[tail:], codec.starts(raw[safe:cut].decode()) + safe, ends, ids, starts, a, cut - AHEAD
            )
            p = int(found[-1]) if len(found) else None
        if p is not None and b == len(raw):
            q = len(raw)
        elif p is not None:
            head = np.searchsorted(ends_r, b, side="right")
            found = _agree(
                ends_r[:head], right.ids[:head], codec.starts(raw[cut:b].decode()) + cut, ends, ids, starts, cut - 1, b - AHEAD
            )
            q = int(found[0]) if len(found) else None
        if p is not None and q is not None:
            first = 0 if p == a else int(np.searchsorted(ends, p)) + 1
            last = int(np.searchsorted(ends, q)) + 1
            before = 0 if p == 0 else int(np.searchsorted(ends_l, p)) + 1
            behind = len(right.ids) if q == len(raw) else int(np.searchsorted(ends_r, q)) + 1
            return Piece(raw, np.concatenate([left.ids[:before], ids[first:last], right.ids[behind:]]))
        reach *= 2


def join_all(codec: Codec, pieces: list[Piece]) -> Piece:
    """Joins neighbours pairwise until one piece is left."""
    while len(pieces) > 1:
        pieces = [
            join(codec, pieces[i], pieces[i + 1]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)
        ]
    return pieces[0] if pieces else Piece(b"", np.empty(0, np.uint32))


def halves(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], most) + halves(text[mid:], most)


def runs(codec: Codec, text: str, most: int) -> list[list[str]]:
    """The text's stretches between special tokens in turn with these; each as its pieces."""
    if codec.special is None or not codec.special.search(text):
        return [halves(text, most)]
    out, at = [], 0
    for m in codec.special.finditer(text):
        out += [halves(text[at : m.start()], most), [m.group()]]
        at = m.end()
    return [*out, halves(text[at:], most)]


def encode_tree(codec: Codec, text: str, most: int = LONG // 2) -> np.ndarray:
    """Encodes a text of any length by halves, in one process."""
    out = []
    for k, run in enumerate(runs(codec, text, most)):
        if k % 2:
            out.append(np.array([codec.special_ids[run[0]]], np.uint32))
        else:
            out.append(join_all(codec, [Piece(p.encode(), codec.encode(p)) for p in run]).ids)
    return np.concatenate(out)


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encode(docs: DataFrame, path: str | None = None, long: int = LONG, decoded: bool = False) -> DataFrame:
    """(doc_id, ids binary, n_tokens long), one row per row of ``docs`` (doc_id, text).

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text has no ids.
    Ids may repeat or be null. Other columns are ignored. The tokenizer file at ``path``
    must exist wherever tasks run. With ``decoded`` a column ``text`` holds what the ids decode
    to, in the same pass: one Python process a core instead of two.
    """
    path, most = path or default_path(), max(1, long // 2)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > long

    def whole(texts: list[str]) -> list[list]:
        of = codec(path)
        ids = [of.encode(t) for t in texts]
        return [[_packed(x) for x in ids], [len(x) for x in ids], *([[of.decode(x) for x in ids]] if decoded else [])]

    def cut(texts: list[str]) -> list[list]:
        of = codec(path)
        made = [[(k, p) for k, run in enumerate(runs(of, t, most)) for p in run] for t in texts]
        return [[[p for _, p in x] for x in made], [[k for k, _ in x] for x in made]]

    def each(pieces: list[str]) -> list[list]:
        of = codec(path)
        return [[_packed(of.encode(p)) for p in pieces]]

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        of = codec(path)
        out = []
        for k, run in group.sort_values("_at").groupby("_run", sort=True):
            ids = [np.frombuffer(x, "<u4") for x in run["ids"]]
            out.append(ids[0] if k % 2 else join_all(of, [Piece(of.raw(x), x) for x in ids]).ids)
        ids = np.concatenate(out)
        text = {"text": [of.decode(ids)]} if decoded else {}
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "ids": [_packed(ids)], "n_tokens": [len(ids)]} | text)

    coded = {"ids": "binary", "n_tokens": "long"} | ({"text": "string"} if decoded else {})
    schema = ", ".join(f"{n} {t}" for n, t in coded.items())
    short_rows = with_columns(docs.where(~is_long), "text", coded, whole)
    cuts = with_columns(numbered(docs).where(is_long), "text", {"_pieces": "array<string>", "_runs": "array<int>"}, cut)
    pieces = cuts.select("_row", "doc_id", F.posexplode(F.arrays_zip("_pieces", "_runs")).alias("_at", "_p")).select(
        "_row", "doc_id", "_at", F.col("_p._runs").alias("_run"), F.col("_p._pieces").alias("_piece")
    )
    done = with_columns(pieces.repartition("_row", "_at"), "_piece", {"ids": "binary"}, each)
    # an id may be null, which pandas can't keep in a column of integers; it travels as text
    keyed = done.select("_row", F.col("doc_id").cast("string").alias("doc_id"), "_at", "_run", "ids")
    long_rows = keyed.groupBy("_row").applyInPandas(joined, f"doc_id string, {schema}")
    return short_rows.unionByName(long_rows.select(F.col("doc_id").cast("long").alias("doc_id"), *coded))


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` with a column ``text`` decoded from ``ids``; null ids give a null text."""
    path, coded = path or default_path(), coded.drop("text")

    def texts(ids: list[bytes | None]) -> list[list]:
        of = codec(path)
        return [[None if x is None else of.decode(np.frombuffer(x, "<u4")) for x in ids]]

    return with_columns(coded, "ids", {"text": "string"}, texts, drop=False)
