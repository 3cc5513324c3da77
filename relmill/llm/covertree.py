"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to cells by their nearest pivot; a cell is cut into blocks of bounded size.
Queries form blocks in the same way. Each query block first meets one data block of its
own cell, which gives every query a k-th score to beat. Every other data block is then
visited only if the bound from the centres and covering radii of both blocks reaches the
worst k-th score of the query block. Inside a pair of blocks a cover tree over the queries
and one over the data are walked together, with the same bound on pairs of nodes.

Pivots come from a sample of at most ``SAMPLE`` rows and only steer which rows lie
together; every row is indexed and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmill.llm.common import bounded_batches, stored

SAMPLE, CELLS = 2048, 16
#: Rows in a data block and in a query block; query blocks that one task meets at most.
BLOCK, QUERY_BLOCK, TOGETHER = 8192, 512, 32
LEAF, FAN = 64, 16


@dataclass
class Node:
    """Rows ``low`` to ``high`` of the tree's order, all within ``radius`` of ``center``."""

    low: int
    high: int
    center: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Each level covers a node's rows by balls of half its radius, around rows of its own.

    A node has ``FAN`` children at most: rows that so many balls don't reach join the
    nearest one, and its radius is what they need. Radii are always those of the real rows.
    """

    def __init__(self, rows: np.ndarray) -> None:
        self.order = np.arange(len(rows))
        self.points = rows.astype(np.float64)
        self.root = self._build(0, len(rows)) if len(rows) else None
        self.rows = rows[self.order]
        self.points = self.points[self.order]

    def _build(self, low: int, high: int) -> Node:
        mine = self.order[low:high]
        points = self.points[mine]
        mean = points.mean(axis=0)
        first = int(np.argmin(((points - mean) ** 2).sum(axis=1)))
        near = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
        node = Node(low, high, points[first], float(near.max()))
        if high - low <= LEAF or node.radius == 0:
            return node
        owner, half = np.zeros(len(mine), np.int64), node.radius / 2
        for c in range(1, FAN):
            far = int(np.argmax(near))
            if near[far] <= half:
                break
            there = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
            closer = there < near
            owner[closer], near = c, np.minimum(near, there)
        by = np.argsort(owner, kind="stable")
        self.order[low:high] = mine[by]
        ends = np.cumsum(np.bincount(owner))
        at = low
        for end in ends.tolist():
            if low + end > at:
                node.children.append(self._build(at, low + end))
            at = low + end
        return node


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.ids, self.k, self.floor = ids, k, floors.copy()
        self.q = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)

    def offer(self, low: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the queries from ``low`` on with the rows ``ids``."""
        mine = slice(low, low + len(scores))
        q, c = np.nonzero((scores >= self.floor[mine, None]) & (ids[None, :] != self.ids[mine, None]))
        if not len(q):
            return
        inside = (self.q >= low) & (self.q < low + len(scores))
        all_q = np.concatenate([self.q[inside], q + low])
        all_s = np.concatenate([self.score[inside], scores[q, c].astype(np.int64)])
        all_i = np.concatenate([self.id[inside], ids[c]])
        order = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[all_q[last]] = np.maximum(self.floor[all_q[last]], all_s[last])
        self.q = np.concatenate([self.q[~inside], all_q[keep]])
        self.score = np.concatenate([self.score[~inside], all_s[keep]])
        self.id = np.concatenate([self.id[~inside], all_i[keep]])


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, floors: np.ndarray, k: int) -> Best:
    """Walks both trees; ``query_ids``, ``data_ids`` and ``floors`` follow the rows the trees were built from."""
    best = Best(query_ids[queries.order], floors[queries.order], k)
    if queries.root is None or data.root is None:
        return best
    ids = data_ids[data.order]
    top = [float(np.abs(t.points).max(initial=0)) for t in (queries, data)]
    exact = top[0] * top[1] * max(1, queries.points.shape[1]) < 2**53  # products and sums are whole numbers
    norms: dict[int, float] = {}

    def norm(node: Node) -> float:
        if id(node) not in norms:
            norms[id(node)] = float(np.sqrt(node.center @ node.center))
        return norms[id(node)]

    def bound(q: Node, d: Node) -> float:
        reach = norm(q) * d.radius + norm(d) * q.radius + q.radius * d.radius
        middle = float(q.center @ d.center)
        return middle + reach + 1e-9 * (abs(middle) + reach) + 1e-3

    def visit(q: Node, d: Node) -> None:
        if bound(q, d) < best.floor[q.low : q.high].min():
            return
        if not q.children and not d.children:
            for low in range(d.low, d.high, 4096):
                high = min(low + 4096, d.high)
                if exact:
                    scores = queries.points[q.low : q.high] @ data.points[low:high].T
                else:
                    scores = queries.rows[q.low : q.high] @ data.rows[low:high].T
                best.offer(q.low, scores, ids[low:high])
        elif q.children and (not d.children or q.radius > d.radius):
            for child in q.children:
                visit(child, d)
        else:
            for child in sorted(d.children, key=lambda c: -bound(q, c)):
                visit(q, child)

    visit(queries.root, data.root)
    return best


def pivots_of(rows: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Rows far from each other: the top of a cover tree, farthest first."""
    if not len(rows):
        return rows
    points = rows.astype(np.float64)
    chosen = [int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < cells and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; rows with a null id, vector or component, or one that is not finite, go."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(
        "vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("v")
    )


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in values]) if len(values) else np.empty((0, 0), np.int64)


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim, cell and gap (distance to the cell's pivot)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, gap = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            dims = np.array([len(v) for v in batch["v"]], np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = _matrix(batch["v"].iloc[at]).reshape(len(at), dim).astype(np.float64)
                to = pivots.get(int(dim), np.zeros((1, dim)))
                squares = (points**2).sum(1)[:, None] - 2 * points @ to.T + (to**2).sum(1)
                cell[at] = squares.argmin(axis=1)
                gap[at] = np.sqrt(((points - to[cell[at]]) ** 2).sum(axis=1))
            yield batch.assign(dim=dims, cell=cell, gap=gap)

    return bounded_batches(rows).mapInPandas(run, "vec_id long, v array<long>, dim int, cell int, gap double")


def _blocked(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block number ``part`` in the cell, and (dim, cell, part, reach) of the blocks."""
    parts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("_parts"))
    rows = rows.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "_parts").cast("int"))
    return rows, rows.groupBy("dim", "cell", "part").agg(F.max("gap").alias("reach"))


def _meet(pairs: DataFrame, data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scores of the block pairs (dim, cell, part, q_cell, q_part): (query_id, vec_id, score), the k best of each query in each pair.

    A group is one data block with at most ``TOGETHER`` query blocks.
    """
    turn = F.floor(F.col("q_part") / TOGETHER)
    pairs = pairs.withColumn("turn", F.concat_ws(":", "q_cell", turn))
    key = ["dim", "cell", "part", "turn"]
    left = data.join(pairs.select(*key).distinct(), ["dim", "cell", "part"]).select(*key, "vec_id", "v")
    own = queries.select("dim", F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), "vec_id", "v", "floor")
    to = [f"to_{c}" for c in key]
    right = pairs.join(own, ["dim", "q_cell", "q_part"]).select(*[F.col(c).alias(t) for c, t in zip(key, to)], "q_part", "vec_id", "v", "floor")

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        tree, ids = CoverTree(_matrix(rows["v"])), rows["vec_id"].to_numpy(np.int64)
        out = []
        for _, block in asked.groupby("q_part"):
            index, own_ids = CoverTree(_matrix(block["v"])), block["vec_id"].to_numpy(np.int64)
            best = search(index, own_ids, tree, ids, block["floor"].fillna(-np.inf).to_numpy(np.float64), k)
            out.append(pd.DataFrame({"query_id": best.ids[best.q], "vec_id": best.id, "score": best.score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return left.groupBy(*key).cogroup(right.groupBy(*to)).applyInPandas(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` (vec_id, embedding) with the largest inner product.

    Components count as floor(``scale`` * x). Queries are the rows for which ``is_query`` (on
    vec_id) holds; rows with the query's own vec_id are no candidates, ties go to the smaller
    vec_id, and there are fewer rows where candidates are few. Rows that repeat an id are
    candidates each; a repeated query id is asked once, with its least vector. Vectors of
    different lengths don't meet. Rows with null or unusable vectors take no part.
    """
    rows = quantised(vectors, scale)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    dims = np.array([len(v) for v in sample["v"]], np.int64)
    pivots = {int(d): pivots_of(_matrix(sample["v"][dims == d])) for d in np.unique(dims)}
    dealt = stored(_dealt(rows, pivots))
    data, blocks = _blocked(dealt, BLOCK)
    asked = dealt.where(is_query).groupBy("vec_id").agg(F.min_by(F.struct("v", "dim", "cell", "gap"), "v").alias("_q")).select("vec_id", "_q.*")
    queries, groups = _blocked(asked, QUERY_BLOCK)
    data, queries, blocks = stored(data), stored(queries.withColumn("floor", F.lit(None).cast("double"))), stored(blocks)
    groups = stored(groups).select("dim", F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("reach").alias("q_reach"))

    count = blocks.groupBy("dim", "cell").agg(F.count("*").alias("_n"))
    home = groups.join(count.withColumnRenamed("cell", "q_cell"), ["dim", "q_cell"]).select(
        "dim", F.col("q_cell").alias("cell"), F.pmod("q_part", "_n").cast("int").alias("part"), "q_cell", "q_part"
    )
    near = stored(_ranked(_meet(home, data, queries, k), k))
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    queries = stored(queries.drop("floor").join(floors, "vec_id", "left"))
    worst = queries.groupBy("dim", F.col("cell").alias("q_cell"), F.col("part").alias("q_part")).agg(
        F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("worst")
    )
    tops = {(d, q, c): (float(a @ b), float(np.sqrt(a @ a)), float(np.sqrt(b @ b))) for d, p in pivots.items() for q, a in enumerate(p) for c, b in enumerate(p)}
    middles = vectors.sparkSession.createDataFrame([(*key, *v) for key, v in tops.items()], "dim int, q_cell int, cell int, middle double, q_norm double, norm double")
    # blocks with blocks, never rows with rows; pivots and cells are few
    meeting = groups.join(worst, ["dim", "q_cell", "q_part"]).join(blocks, "dim").join(middles, ["dim", "q_cell", "cell"], "left")
    reach = F.col("q_norm") * F.col("reach") + F.col("norm") * F.col("q_reach") + F.col("q_reach") * F.col("reach")
    bound = F.col("middle") + reach + 1e-9 * (F.abs("middle") + reach) + 1e-3
    other = meeting.where(F.col("worst").isNull() | F.col("middle").isNull() | (bound >= F.col("worst"))).select("dim", "cell", "part", "q_cell", "q_part")
    far = other.join(home, ["dim", "cell", "part", "q_cell", "q_part"], "left_anti")
    found = _meet(far, data, queries, k).unionByName(near.select("query_id", "vec_id", "score"))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
