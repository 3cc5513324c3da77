"""Connected components of a link table, by star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import stored

MAX_ROUNDS = 100


def _digest(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("a", "b"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): one row per node that isn't the least of its component, with that least node.

    Each round hangs the larger neighbours of every node under its least neighbour (large
    star), then all smaller neighbours (small star), until nothing changes; the rounds grow
    with the logarithm of the longest chain. Only minima and links move, a node's neighbours
    are never gathered into one row, and the minima combine before the shuffle. Self links,
    nulls and repeated links are dropped. Returns (node, root); no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min(b).alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = stored(
            both.where(b > a).join(least, "a").select(b.alias("a"), F.col("_m").alias("b")).where(a != b).distinct()
        )
        root = large.groupBy("a").agg(F.min(b).alias("_m"))
        joined = large.join(root, "a")
        small = joined.select(b.alias("a"), F.col("_m").alias("b")).unionByName(
            joined.select(a, F.col("_m").alias("b"))
        )
        now = stored(small.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
        was, seen = seen, _digest(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(a.alias("node"), b.alias("root"))
