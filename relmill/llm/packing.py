"""Packs token ids into rows of one length, for training.

Best-fit-decreasing: the longest segment goes first, each into the fullest row that still
has room. A segment tree over the free lengths finds that row in a logarithmic number of
steps. Documents longer than a row are split into whole rows and a rest; nothing is cut off.

Each task packs its own documents in groups of about ``GROUP_TOKENS``, so nothing is
shuffled and memory does not depend on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.bpe import codec, default_path
from relmill.llm.common import bounded_batches

LENGTH = 2048
GROUP_TOKENS = 4_000_000

SCHEMA = (
    "task int, pack int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, members array<int>, offsets array<int>"
)
_ARROW = pa.schema(
    [("task", pa.int32()), ("pack", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary())]
    + [(n, pa.list_(pa.int32())) for n in ("cu_seqlens", "position_resets")]
    + [("doc_ids", pa.list_(pa.int64()))]
    + [(n, pa.list_(pa.int32())) for n in ("members", "offsets")]
)


class FreeLengths:
    """A segment tree over the lengths 0 to ``most``: is there a row with so much room left?"""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.largest = [-1] * (2 * self.size)  # the largest free length below each node
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _set(self, length: int, value: int) -> None:
        at = self.size + length
        self.largest[at] = value
        while at > 1:
            at //= 2
            value = max(self.largest[2 * at], self.largest[2 * at + 1])
            if self.largest[at] == value:
                break
            self.largest[at] = value

    def put(self, length: int, row: int) -> None:
        self.rows[length].append(row)
        if len(self.rows[length]) == 1:
            self._set(length, length)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the smallest room of ``least`` at least, and that room; it leaves the tree."""
        if self.largest[1] < least:
            return None
        at, low, width = 1, 0, self.size
        while at < self.size:
            width //= 2
            # the left half holds smaller lengths; its largest decides
            if self.largest[2 * at] >= least:
                at *= 2
            else:
                at, low = 2 * at + 1, low + width
        row = self.rows[low].pop()
        if not self.rows[low]:
            self._set(low, -1)
        return row, low


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of segment numbers; no row's sizes exceed ``length`` together."""
    free, rows = FreeLengths(length), []
    for s in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[s])
        found = free.take(size)
        if found is None:
            rows.append([s])
            row, room = len(rows) - 1, length - size
        else:
            row, room = found[0], found[1] - size
            rows[row].append(s)
        if room:
            free.put(room, row)
    return rows


def _group(docs: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, task: int, first: int) -> pa.RecordBatch:
    segments = [(d, m, at, ids[at : at + length]) for d, m, ids in docs for at in range(0, len(ids), length)]
    rows = best_fit(np.array([len(s[3]) for s in segments], np.int64), length)
    cols: dict[str, list] = {n: [] for n in _ARROW.names}
    for k, row in enumerate(rows):
        parts = [segments[s] for s in row]
        ends = np.cumsum([0, *(len(p[3]) for p in parts)])
        ids = np.full(length, pad, parts[0][3].dtype)
        ids[: ends[-1]] = np.concatenate([p[3] for p in parts])
        values = (task, first + k, int(ends[-1]), ids.tobytes(), ends, ends[:-1], [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts])
        for name, value in zip(_ARROW.names, values):
            cols[name].append(value)
    return pa.RecordBatch.from_pydict(cols, schema=_ARROW)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, pad: int = 0, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and packs the ids; one row per packed row.

    ``ids``: ``length`` little-endian unsigned ids, filled up with ``pad`` (16 bits each if
    the vocabulary allows, else 32). ``cu_seqlens``: where segments start, and the end.
    ``position_resets``: where positions start from 0 again. For each segment: its document's
    id, ``members`` (the document's number in its task; repeated or null ids stay apart) and
    ``offsets`` (where it starts in its document). ``task`` and ``pack`` name the row. Null
    and empty texts have no ids and no segment.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        kind = "<u2" if len(of.length) <= 1 << 16 else "<u4"
        task, made, member, held, docs_held = TaskContext.get().partitionId(), 0, 0, 0, []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = of.encode(text or "").astype(kind)
                if len(ids):
                    docs_held.append((doc, member, ids))
                    held += len(ids)
                member += 1
                if held >= group_tokens:
                    out = _group(docs_held, length, pad, task, made)
                    made, held, docs_held = made + out.num_rows, 0, []
                    yield from _slices(out)
        if docs_held:
            yield from _slices(_group(docs_held, length, pad, task, made))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, SCHEMA)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def unpack(packed: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, ids binary): the ids of every document with any, from written rows. ``wide``: ids have 32 bits."""
    size = 4 if wide else 2
    one = packed.select("task", "ids", F.posexplode(F.arrays_zip("doc_ids", "members", "offsets")).alias("_i", "_s"), "cu_seqlens")
    start, end = F.element_at("cu_seqlens", F.col("_i") + 1), F.element_at("cu_seqlens", F.col("_i") + 2)
    part = F.substring("ids", start * size + 1, (end - start) * size)
    flat = one.select("task", F.col("_s.doc_ids").alias("doc_id"), F.col("_s.members").alias("_m"), F.col("_s.offsets").alias("_o"), part.alias("_p"))

    def restore(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_o")
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "ids": [b"".join(group["_p"])]})

    keyed = flat.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = keyed.groupBy("task", "_m").applyInPandas(restore, "doc_id string, ids binary")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")


def write_packed(docs: DataFrame, folder: str, **options) -> None:
    """Writes ``pack(docs)`` as Parquet files below ``folder``, one or more a task."""
    pack(docs, **options).write.mode("error").parquet(folder)
