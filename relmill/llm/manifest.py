"""A Merkle manifest of a dataset, grown by appends, with a witness for every document.

Each source is a tree over its documents in order of ``doc_id``: runs of ``ARITY`` nodes
become one, level by level. Documents are dealt to aligned blocks of ``ARITY ** height``
leaves by their place in the source, so a hot source is many blocks. Within a block one task
appends leaf by leaf: a leaf joins the open run of its level, and as a sibling completes the
run, the partial witnesses below it are extended by what stands beside them. The roots of
the blocks are then the leaves of the next tier, that is, further appends; the roots of the
sources are appended in the same way to one last tree. Witnesses are completed on the way
back, a tier at a time.

``append`` may be called again with later documents: full blocks stay as they are, only the
open block of a source is reread, and ``witnesses`` hashes what is above the blocks anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmill.llm.common import stored

ARITY = 3
#: Levels of a block; 729 leaves are one task's open state and one row of about 100 KB.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf(fields: Sequence[Column | str] = FIELDS) -> Column:
    """SHA-256 over the fields in order, each ``-`` if null, else its UTF-8 length, ``:`` and its value."""
    texts = [F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Tree:
    """The open runs of one block, and what the witnesses of its leaves hold so far."""

    def __init__(self, witnessed: bool = True) -> None:
        self.witnesses: list[list[tuple[str, str]]] = []
        self.witnessed = witnessed
        self.size = 0
        self.open: list[list[tuple[str, int, int]]] = [[]]

    def append(self, digest: str) -> None:
        if self.witnessed:
            self.witnesses.append([])
        self._add(0, (digest, self.size, self.size + 1))
        self.size += 1

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        if self.witnessed:
            for i, (_, first, end) in enumerate(run):
                step = ("".join(digests[:i]), "".join(digests[i + 1 :]))
                for place in range(first, end):
                    self.witnesses[place].append(step)
        self._add(level + 1, (_hash(digests), run[0][1], run[-1][2]))

    def close(self, height: int, alone: bool) -> str:
        """Completes the runs that stay short and returns the root, at full height unless the block is ``alone``."""
        if alone:
            height = next(h for h in range(height + 1) if ARITY**h >= self.size)
        for level in range(height):
            if len(self.open) > level and self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def _grown(digests: list[str], block: int, height: int, witnessed: bool) -> tuple[str, list[list[tuple[str, str]]]]:
    tree = Tree(witnessed)
    for digest in digests:
        tree.append(digest)
    # A block with others behind it is full, so only the first can be short and alone.
    return tree.close(height, alone=block == 0), tree.witnesses


def _placed(rows: DataFrame, order: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``pos``, the place among the rows of equal ``_key``, behind the ``sizes`` (_key, _old) already there.

    Rows are dealt by ranges of (key, order), so that a hot key is spread; only the counts of
    each key in each range are brought together.
    """
    part, seq = F.spark_partition_id(), F.monotonically_increasing_id()
    ranged = stored(
        rows.repartitionByRange("_key", *order)
        .sortWithinPartitions("_key", *order)
        .withColumn("_part", part)
        .withColumn("_seq", seq)
    )
    starts = ranged.groupBy("_key", "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("_before", F.coalesce(before, F.lit(0)))
    if sizes is not None:
        starts = starts.join(sizes, "_key", "left").withColumn("_before", F.col("_before") + F.coalesce("_old", F.lit(0)))
    starts = starts.select("_key", "_part", (F.col("_before") - F.col("_first")).alias("_shift"))
    placed = ranged.join(starts, ["_key", "_part"]).withColumn("pos", F.col("_seq") + F.col("_shift"))
    return placed.drop("_part", "_seq", "_shift")


def _blocks(nodes: DataFrame, carried: list[str], height: int) -> DataFrame:
    """(_key, block, items): at most ``ARITY ** height`` nodes a row, in order."""
    item = F.struct("pos", "digest", *carried)
    return nodes.groupBy("_key", F.expr(f"pos div {ARITY**height}").alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )


def append(
    docs: DataFrame, blocks: DataFrame | None = None, carry: dict[str, Column] | None = None, height: int = HEIGHT
) -> DataFrame:
    """The blocks of a manifest: (_key, block, items), for all documents or added to earlier ``blocks``.

    ``carry`` names further columns to keep beside each leaf; they may read all of ``docs``.
    Null sources are one source. Null ids come first; repeated rows are leaves of their own.
    A source only grows at its end: ids must be above those it has, or a ValueError tells so.
    All appends and ``witnesses`` take the same ``height``, the levels of a block.
    Columns other than ``FIELDS`` are not read; an empty table adds nothing.
    """
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key")
    new = stored(docs.select(key, "doc_id", leaf().alias("digest"), *(c.alias(n) for n, c in carry.items())))
    if blocks is None:
        return stored(_blocks(_placed(new, ["doc_id", "digest"]), ["doc_id", *carry], height))
    sizes = blocks.groupBy("_key").agg(
        F.sum(F.size("items")).alias("_old"), F.max(F.expr("array_max(transform(items, i -> i.doc_id))")).alias("_last")
    )
    first = new.groupBy("_key").agg(F.min("doc_id").alias("_id"), F.count_if(F.col("doc_id").isNull()).alias("_nulls"))
    late = first.join(sizes, "_key").where("_id <= _last or _nulls > 0").select("_key").first()
    if late:
        raise ValueError(f"a source only grows at its end, but ids come late for {late[0]!r}")
    added = _blocks(_placed(new, ["doc_id", "digest"], sizes.select("_key", "_old")), ["doc_id", *carry], height)
    is_full = F.size("items") == ARITY**height
    both = blocks.where(~is_full).unionByName(added).groupBy("_key", "block")
    grown = both.agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    return stored(blocks.where(is_full).unionByName(grown))


def _rows(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # a row is a whole block
                yield make(batch.slice(at, 16))

    return df.mapInArrow(run, schema)


def _roots(blocks: DataFrame, height: int) -> DataFrame:
    """The blocks as nodes of the next tier: (_key, pos, digest)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = batch.column("block")
        found = [_grown(d, b, height, False)[0] for d, b in zip(batch.column("digests").to_pylist(), block.to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("_key"), block, pa.array(found, pa.string())], ["_key", "pos", "digest"])

    return _rows(blocks.select("_key", "block", F.col("items.digest").alias("digests")), "_key string, pos long, digest string", make)


def _below(blocks: DataFrame, upper: DataFrame, items: list[str], tops: list[str], height: int) -> DataFrame:
    """The items of ``blocks`` with their whole witness, given that of each block: ``upper`` (_key, pos, witness, ``tops``)."""
    upper = upper.withColumnRenamed("pos", "block").withColumnRenamed("witness", "above")
    joined = blocks.join(upper, ["_key", "block"])
    types = {f.name: f.dataType.simpleString() for f in blocks.schema["items"].dataType.elementType}
    schema = ", ".join(["_key string", *(f"{i} {types[i]}" for i in items), *(f"{t} string" for t in tops), f"witness {WITNESS}"])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        nested = batch.column("items")
        row = pc.list_parent_indices(nested)
        flat = nested.flatten()
        left: list[str] = []
        right: list[str] = []
        offsets = [0]
        columns = (batch.column(c).to_pylist() for c in ("digests", "block", "above"))
        for digests, block, above in zip(*columns):
            rest = [(s["left"], s["right"]) for s in above]
            for witness in _grown(digests, block, height, True)[1]:
                for a, b in witness + rest:
                    left.append(a)
                    right.append(b)
                offsets.append(len(left))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_STEP))
        witness = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
        fields = [flat.field(flat.type.get_field_index(i)) for i in items]
        above = [batch.column(t).take(row) for t in tops]
        return pa.RecordBatch.from_arrays([batch.column("_key").take(row), *fields, *above, witness], ["_key", *items, *tops, "witness"])

    return _rows(joined.select("_key", "block", F.col("items.digest").alias("digests"), "items", "above", *tops), schema, make)


def _tiers(blocks: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks up to one block a key, and the root of each key (_key, digest)."""
    tiers = [blocks]
    while True:
        nodes = stored(_roots(tiers[-1], height))
        if nodes.where("pos > 0").isEmpty():
            return tiers, nodes.select("_key", "digest")
        tiers.append(stored(_blocks(nodes, [], height)))


def witnesses(blocks: DataFrame, carried: Sequence[str] = (), height: int = HEIGHT) -> DataFrame:
    """One row per leaf: (doc_id, leaf, subroot, root, witness, ``carried``).

    The witness has a step for each level from the leaf to the root: the digests to the left
    and to the right of the node in its run, joined. No blocks give no rows.
    """
    tiers, subroots = _tiers(blocks, height)
    no_key = subroots.select(F.lit("").alias("_key"), F.col("_key").alias("_source"), "digest")
    over, root = _tiers(stored(_blocks(_placed(no_key, ["_source"]), ["_source"], height)), height)
    upper = root.select("_key", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("root"), F.array().cast(WITNESS).alias("witness"))
    for tier in reversed(over[1:]):
        upper = stored(_below(tier, upper, ["pos"], ["root"], height))
    sources = _below(over[0], upper, ["_source", "digest"], ["root"], height)
    upper = stored(
        sources.select(F.col("_source").alias("_key"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "witness")
    )
    for tier in reversed(tiers[1:]):
        upper = stored(_below(tier, upper, ["pos"], ["subroot", "root"], height))
    leaves = _below(blocks, upper, ["doc_id", "digest", *carried], ["subroot", "root"], height)
    return leaves.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "witness", *carried)


def proof(witness: str = "witness") -> Column:
    """SHA-256 of all siblings of a witness, in its order."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: str, witness: str = "witness") -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(witness, F.col(digest), lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))
