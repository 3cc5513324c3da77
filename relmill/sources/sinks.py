"""Writers for result artefacts, run reports and the route cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.functions.text import strip, text_of
from relmill.sources.scans import latest_routes


def export_document_json(
    df: DataFrame, private: tuple[str, ...] = ("_pages_res",), keep: tuple[str, ...] = ("task_id",)
) -> DataFrame:
    """One JSON text per row, private artefacts left out."""
    public = df.drop(*private)
    fields = [c for c in public.columns if c not in keep]
    return public.select(*keep, F.to_json(F.struct(*fields)).alias("json"))


def result_artifacts(
    results: DataFrame, paragraphs: str = "paragraphs", text: str = "document_text"
) -> DataFrame:
    """The three artefacts of every task: full JSON, document text, paragraph JSON."""
    fields = [c for c in results.columns if c not in ("task_id", "_pages_res")]
    return results.select(
        "task_id",
        F.to_json(F.struct(*fields)).alias("result_json"),
        F.concat(strip(text_of(F.col(text))), F.lit("\n")).alias("document_text"),
        F.coalesce(F.to_json(paragraphs), F.lit("[]")).alias("ocr_paragraphs"),
    )


def write_results(
    results: DataFrame, path: str, paragraphs: str = "paragraphs", text: str = "document_text"
) -> dict[str, str]:
    """Write each artefact as its own dataset, one folder per task.

    Rows are clustered by task first, so every task folder gets exactly one file.
    """
    parts = result_artifacts(results, paragraphs, text)
    artefacts = {
        "result_json": parts.select("task_id", F.col("result_json").alias("value")),
        # the writer ends the text with its own line break
        "document_text_md": parts.select("task_id", strip(F.col("document_text")).alias("value")),
        "ocr_paragraphs_json": parts.select("task_id", F.col("ocr_paragraphs").alias("value")),
    }
    paths = {}
    for name, table in artefacts.items():
        paths[name] = f"{path}/{name}"
        (
            table.repartition("task_id")
            .write.mode("overwrite")
            .partitionBy("task_id")
            .text(paths[name])
        )
    return paths


def run_meta(summary: DataFrame, backend: str, model: str) -> DataFrame:
    """One row: backend, model, sample count, total seconds."""
    return summary.agg(
        F.lit(backend).alias("backend"),
        F.lit(model).alias("model"),
        F.count("*").alias("sample_count"),
        F.round(F.sum("sample_wall_seconds"), 4).alias("total_wall_seconds"),
    )


def write_run_report(
    results: DataFrame, summary: DataFrame, path: str, backend: str, model: str
) -> dict[str, str]:
    paths = {"meta": f"{path}/meta", "results": f"{path}/results"}
    run_meta(summary, backend, model).coalesce(1).write.mode("overwrite").json(paths["meta"])
    results.write.mode("overwrite").json(paths["results"])
    return paths


def merge_routes(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache rows with the new ones, the last write per hash winning."""
    return latest_routes(cache.unionByName(fresh))


def write_route_cache(fresh: DataFrame, path: str) -> None:
    """Append new routes; readers take the newest row per hash, so nothing is rewritten."""
    fresh.select(
        "doc_hash", "route", F.current_timestamp().alias("written_at")
    ).write.mode("append").parquet(path)
