"""Spelling variants: words one edit apart, found by asymmetric chunks.

The shorter word of a pair gives two disjoint chunks, its halves; the other gives its
positional grams of the same lengths. One edit leaves a chunk whole, and moves it by one
place at most, so a join of chunks with grams within that shift misses no pair: the left
half is met at the front, the right half at the end of the other word. The grams at other
places can meet no chunk and are not made. An exact edit distance follows.

A bucket of words that share a chunk may be large. It isn't compared pair by pair: the half
that holds the edit is halved again, and what is whole of it lengthens the key, until a
bucket is small or the edit is pinned to one place, where the alphabet bounds the bucket.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import stored

#: Letters of a run, in lower case, and the least length of a word.
LETTERS, SHORTEST = "a-zÀ-ÿ", 7
#: Word pairs in a bucket above which it is divided; results don't depend on it.
LIMIT = 4096
#: How many times more frequent a form must be than its variant.
RATIO = 10
#: One run in so many loses a letter, by the crc32 of document and run.
DAMAGED = 31


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, counted; null texts have none, a null id counts as empty text.

    Runs are maximal and of ASCII letters in lower case and U+00C0 to U+00FF. Where ``DAMAGED``
    divides the crc32 h of ``<doc_id>:<run>``, the run loses its letter number h % length.
    Counts combine before the shuffle. Shorter and rarer words are left out.
    """
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("_run"),
    )
    runs = runs.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")))
    cut = F.expr("concat(substring(_run, 1, int(_h % length(_run))), substring(_run, int(_h % length(_run)) + 2))")
    words = runs.select(F.when(F.col("_h") % DAMAGED == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(regions: DataFrame) -> DataFrame:
    """Adds the key of rows (word, _len, _lo, _hi): the word without what lies between the two places."""
    tail = F.expr("substring(word, length(word) - (_len - _hi) + 1)")
    return regions.withColumn("_key", F.xxhash64("_len", "_lo", "_hi", F.expr("substring(word, 1, _lo)"), tail))


def _halves(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.inline(
        F.array(F.struct(lo.alias("_lo"), middle.alias("_hi")), F.struct(middle.alias("_lo"), hi.alias("_hi")))
    )


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): each two of the distinct ``word`` values that differ by one inserted, deleted or replaced code point, once.

    ``a`` is the shorter, or the lesser of equally long ones. Words of one letter are compared
    by their empty chunk. Nulls take no part.
    """
    words = words.where(F.col("word").isNotNull()).select("word").distinct()
    size = F.length("word").cast("int")
    # A word stands under its own length, and as the longer one of a pair under one less.
    todo = words.select("word", F.explode(F.array(size, size - 1)).alias("_len")).where("_len > 0")
    todo = todo.select("word", "_len", _halves(F.lit(0), F.col("_len")))
    found = None
    while True:
        rows = stored(_keyed(todo).withColumn("_own", F.length("word") == F.col("_len")))
        bucket = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.sum(F.col("_own").cast("long")).alias("_owners"))
        rows = stored(rows.join(bucket.where("_n > 1 and _owners > 0"), "_key"))
        large = (F.col("_n") * F.col("_owners") > limit) & (F.col("_hi") - F.col("_lo") > 1)
        small = rows.where(~large)
        x, y = small.where("_own").select("_key", F.col("word").alias("a")), small.select("_key", F.col("word").alias("b"), "_own")
        pairs = x.join(y, "_key").where("(not _own or a < b) and levenshtein(a, b, 1) = 1").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        todo = rows.where(large).select("word", "_len", _halves(F.col("_lo"), F.col("_hi")))
        if todo.isEmpty():
            return found.distinct()


def variants(counts: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``counts`` (word, n), which must be distinct.

    ``form`` is the near word of largest n (ties: the first in code-point order), if it is
    ``ratio`` times as frequent; else null. ``root`` follows forms to the last and is the word
    itself without one. Counts grow by ``ratio`` at each step, so there is no cycle, and each
    round of the search doubles the steps seen. An empty table gives no rows.
    """
    counts = stored(counts.select("word", "n"))
    pairs = stored(near_pairs(counts, limit))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    with_n = both.join(counts.select(F.col("word").alias("b"), "n"), "b")
    best = with_n.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("b").alias("b"))).alias("_best")
    )
    rows = counts.join(best, "word", "left").withColumn("_top", -F.col("_best.m"))
    chosen = F.col("_top") >= ratio * F.col("n")
    rows = stored(
        rows.select(
            "word", F.when(chosen, F.col("_best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, F.col("_top")).alias("form_n"),
        )
    )
    steps = stored(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ahead = stored(steps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"))
        steps = ahead.select("word", "root")
        if ahead.where("_next is not null").isEmpty():
            break
    return rows.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
