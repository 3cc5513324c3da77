"""Task queue as a stream: ingestion, status log, latest status, open tasks."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relmill.functions.text import is_blank
from relmill.plans.store import stored

# ---- fixed values: stage → status, progress ---------------------------------------------
STAGES = {
    "queued": ("queued", 0),
    "layout_parsing": ("ocr_running", 10),
    "restructure_pages": ("ocr_running", 30),
    "relation_extraction": ("extracting", 55),
    "document_merge": ("merging", 85),
    "completed": ("succeeded", 100),
    "failed": ("failed", 100),
}
FINISHED = ("succeeded", "failed")
# -----------------------------------------------------------------------------------------


def _stage_value(stage: Column, position: int, kind: str) -> Column:
    pairs = [F.lit(x) for s, v in STAGES.items() for x in (s, v[position])]
    return F.try_element_at(F.create_map(*pairs), stage).cast(kind)


def status_log(changes: DataFrame) -> DataFrame:
    """Stage changes ``(task_id, stage, updated_at, error)`` → status rows."""
    stage = F.col("stage")
    return changes.select(
        "task_id",
        "stage",
        _stage_value(stage, 0, "string").alias("status"),
        _stage_value(stage, 1, "int").alias("progress"),
        F.when(stage == "failed", F.col("error")).alias("error"),
        (stage == "completed").alias("result_ready"),
        "updated_at",
    )


def latest_status(log: DataFrame, order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Last state per task. Works on a batch and, in update mode, on a stream.

    On an endless stream the state holds one row per task; a watermark of the caller's
    choice on ``updated_at`` bounds it.
    """
    state = F.struct("stage", "status", "progress", "error", "result_ready", "updated_at")
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    latest = log.groupBy("task_id").agg(
        F.max_by(state, key).alias("s"), F.min("updated_at").alias("created_at")
    )
    return latest.select("task_id", "s.*", "created_at")


def open_tasks(latest: DataFrame) -> DataFrame:
    return latest.filter(~F.col("status").isin(*FINISHED))


def task_results(requests: DataFrame, latest: DataFrame, results: DataFrame) -> DataFrame:
    """Answer per requested task: result, still running, or unknown."""
    known = latest.select("task_id", F.lit(True).alias("_known"))
    done = results.select("task_id", "result")
    joined = requests.select("task_id").join(done, "task_id", "left").join(known, "task_id", "left")
    return joined.select(
        "task_id",
        F.when(F.col("result").isNotNull(), "ready")
        .when(F.col("_known"), "not ready")
        .otherwise("missing")
        .alias("answer"),
        "result",
    )


def failing_tasks(
    batch: DataFrame, transform: Callable[[DataFrame], DataFrame], key: Column, limit: int
) -> dict[str, str]:
    """Tasks on which ``transform`` fails, with the first line of the error.

    Parts that fail are halved by a bit of the task hash until one task is left: about twice
    the logarithm of the batch runs per failing task, each on half the rows. A plan that can't be analysed is nobody's
    failure and raised; so is the last error where more than ``limit`` tasks fail.
    """
    key = key.cast("string")
    found: dict[str, str] = {}
    parts = [(batch, 0)]
    while parts:
        rows, bit = parts.pop()
        ids = [r[0] for r in rows.select(key.alias("k")).distinct().limit(2).collect()]
        if not ids:
            continue
        try:
            transform(rows).write.format("noop").mode("overwrite").save()
            continue
        except AnalysisException:
            raise
        except (PySparkException, Py4JJavaError) as error:
            if len(ids) == 1:
                found[ids[0]] = next((x for x in str(error).splitlines() if x.strip()), "failed")
                if len(found) > limit:
                    raise
                continue
        # a part is read from its own table, so that all halvings together read the batch about twice
        rows = stored(rows)
        side = F.shiftright(F.xxhash64(key), bit).bitwiseAND(1)
        parts += [(rows.filter(side == s), bit + 1) for s in (0, 1)]
    return found


def stream_documents(
    spark: SparkSession,
    path: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    file_format: str = "parquet",
    max_files: int = 100,
    task: str = "doc_id",
    text: str = "text",
    options: dict[str, str] | None = None,
    available_now: bool = True,
    max_failures: int = 100,
) -> StreamingQuery:
    """Run a batch transform over arriving document files.

    Documents without text, and those on which the transform fails, go to ``{out}/errors``
    and never stop the stream; only where more than ``max_failures`` of a micro-batch fail,
    it stops and the batch is run again at the next start. Outputs are keyed by the
    micro-batch number and overwritten on a retry, so a batch that is replayed after a
    failure leaves no duplicates.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    source = reader.option("maxFilesPerTrigger", max_files).options(**(options or {})).load(path)
    key = F.col(task).cast("string")

    def land(batch: DataFrame, number: int) -> None:
        def folder(name: str) -> str:
            return f"{out}/{name}/batch={number}"

        live = batch.filter(~is_blank(F.col(text)))
        failed: dict[str, str] = {}
        try:
            transform(live).write.mode("overwrite").parquet(folder("results"))
        except AnalysisException:
            raise
        except (PySparkException, Py4JJavaError):
            failed = failing_tasks(live, transform, key, max_failures)
            good = live.filter(~F.coalesce(key.isin(list(failed)), F.lit(False)))
            transform(good).write.mode("overwrite").parquet(folder("results"))
        reasons = F.create_map(*[F.lit(x) for pair in failed.items() for x in pair]).cast("map<string,string>")
        error = F.when(is_blank(F.col(text)), "empty document").otherwise(F.try_element_at(reasons, key))
        states = batch.select(
            key.alias("task_id"),
            F.when(error.isNotNull(), "failed").otherwise("completed").alias("stage"),
            error.alias("error"),
            F.current_timestamp().alias("updated_at"),
        )
        status_log(states).write.mode("overwrite").parquet(folder("status"))
        # narrow rows, read back instead of the texts
        log = batch.sparkSession.read.parquet(folder("status"))
        log.filter("stage = 'failed'").select(
            F.col("task_id").cast(batch.schema[task].dataType).alias(task), "error"
        ).write.mode("overwrite").parquet(folder("errors"))

    writer = source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
