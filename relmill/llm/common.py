"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.plans.store import stored

__all__ = ["BATCH_ROWS", "WordCodes", "bounded_batches", "held_out", "numbered", "table", "stored", "with_columns"]

# a worker gives the memory of a batch back at once, which the default pool keeps
pa.set_memory_pool(pa.system_memory_pool())

#: Rows and bytes of an Arrow batch. A batch holds whole texts; one text may be larger than this.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at a time to Python workers."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


_ARROW = {
    "string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
}


def with_columns(
    df: DataFrame, source: str, fields: dict[str, str], make: Callable[[list], Sequence[Sequence]], drop: bool = True
) -> DataFrame:
    """Adds ``fields`` (name to type), which ``make`` computes from a list of ``source`` values.

    ``make`` returns one sequence for each field. The other columns pass through the Python
    workers as they are; ``source`` itself goes unless ``drop`` is false.
    """
    rows = df.drop(source) if drop else df
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{n}` {t}" for n, t in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(source).to_pylist())
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != source or not drop]
            new = [(n, pa.array(v, _ARROW[t])) for (n, t), v in zip(fields.items(), made)]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + new], [n for n, _ in kept + new])

    return bounded_batches(df).mapInArrow(run, schema)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a row number that is unique also where ``doc_id`` repeats or is null.

    It depends on how the scan is split. Use it only in a table that is written once and
    read back, never across two computations of the same plan.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class WordCodes(dict):
    """A bounded cache from word to number, filled by ``code`` on a miss.

    Lookups run at the speed of a dict. A full cache takes no more words: those that came
    first hold the frequent ones, and a worker's memory does not grow with the vocabulary.
    """

    def __init__(self, code: Callable[[str], int], limit: int = 120_000) -> None:
        super().__init__()
        self.code, self.limit = code, limit

    def __missing__(self, word: str) -> int:
        value = self.code(word)
        if len(word) <= 100 and len(self) < self.limit:
            self[word] = value
        return value

    def array(self, words: list[str], dtype=np.int64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


EDGE = re.compile(r"^\W+|\W+$")


def bare(word: str) -> str:
    """A word in lower case without the punctuation around it."""
    return word.lower() if word.isalnum() else EDGE.sub("", word.lower())


def word_hash(word: str) -> int:
    """32 bits; the same in every process."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))
