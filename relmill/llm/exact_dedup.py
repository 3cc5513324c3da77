"""Exact duplicates: texts that are the same bytes after lower-casing A-Z.

Rows are grouped by the first 128 bits of the text's SHA-256 and by the text itself, so the
aggregation compares the bytes of every two rows whose hashes agree. It combines before the
shuffle: a group with a third of all rows sends one text per task. What follows carries no
texts. The verdict goes back to the rows by hash; groups of at least 1/``HOT`` of all rows
are ``HOT`` at most and go to the scan by broadcast, their rows are spread evenly. Where
two texts share a hash, which a count tells, the rows of that hash are joined by their texts.

Only DataFrame functions are used; nothing runs in Python.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import stored

HASH_BYTES = 16
#: A group of at least this fraction of all rows is hot, so there are at most this many.
HOT = 1024


def normalised(column: str = "text") -> F.Column:
    """The text with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_groups(docs: DataFrame, keep: str = "smallest", hash_bytes: int = HASH_BYTES) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    ``keep`` is the id that stays of equal texts, ``"smallest"`` or ``"largest"``. Null and
    empty texts are one group. A null id stays only where its group has no other; ``keep_id``
    is null there. Rows that repeat both id and text count in ``group_size`` and share their
    verdict, as nothing tells them apart. Columns other than doc_id and text are not read; an
    empty table gives no rows. ``hash_bytes`` shortens the hash; results don't depend on it.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]("doc_id")
    rows = docs.select("doc_id", normalised().alias("_text"))
    rows = rows.withColumn("text_sha256", F.sha2("_text", 256))
    rows = rows.withColumn("_hash", F.unhex(F.substring("text_sha256", 1, 2 * hash_bytes)))
    classes = rows.groupBy("_hash", "_text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    by_hash = stored(
        classes.groupBy("_hash").agg(
            F.count("*").alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
            F.sum("group_size").alias("_rows"),
        )
    )
    total, most = by_hash.agg(F.sum("_rows"), F.max("_texts")).first()
    one = by_hash.where("_texts = 1").select("_hash", "keep_id", "group_size")
    is_hot = F.col("group_size") * HOT >= F.lit(total or 0)
    hot = one.where(is_hot).select("_hash", F.col("keep_id").alias("_hot_id"), F.col("group_size").alias("_hot_size"))
    cold = one.where(~is_hot).withColumnRenamed("_hash", "_key")
    spread = F.concat("_hash", F.xxhash64("doc_id").cast("string").cast("binary"))
    found = (
        rows.select("doc_id", "text_sha256", "_hash")
        .join(F.broadcast(hot), "_hash", "left")
        .withColumn("_key", F.when(F.col("_hot_size").isNull(), F.col("_hash")).otherwise(spread))
        .join(cold, "_key", "left")
        .select(
            "doc_id", F.when(F.col("_hot_size").isNull(), F.col("keep_id")).otherwise(F.col("_hot_id")).alias("keep_id"),
            F.coalesce("_hot_size", "group_size").alias("group_size"), "text_sha256",
        )
        .where(F.col("group_size").isNotNull())
    )
    if (most or 0) > 1:
        clash = rows.join(by_hash.where("_texts > 1").select("_hash"), "_hash", "left_semi")
        texts = clash.groupBy("_hash", "_text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(
            clash.join(texts, ["_hash", "_text"]).select("doc_id", "keep_id", "group_size", "text_sha256")
        )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
