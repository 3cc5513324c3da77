"""Materialised intermediate tables.

A multi-step run reads some tables several times. They are written once to the shared
checkpoint folder and read back: the lineage is cut, nothing is recomputed, and a lost
executor costs no more than its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a session in one process (``local[...]``) gets a temporary folder;
    on a cluster each executor would write to its own disk, so the run stops instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/relmill-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and return the table that reads it."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path, compression="zstd")  # texts take about half the room
    return df.sparkSession.read.schema(df.schema).parquet(path)
