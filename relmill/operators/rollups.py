"""Per-document and per-run roll-ups and result views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import posexplode

# ---- fixed values -------------------------------------------------------------------------
FIELD_ORDER = ("head", "relation", "tail", "evidence", "skill")
TIMINGS = (
    "routing_seconds",
    "coref_seconds",
    "chunk_routing_seconds",
    "extraction_seconds",
    "summarize_seconds",
    "proofreading_seconds",
    "refinement_seconds",
    "domain_reflection_seconds",
    "total_seconds",
)
COUNTS = (
    "input_relation_count",
    "high_confidence_count",
    "low_confidence_count",
    "output_relation_count",
)
VIEWS = {
    "final": ("final_relation_list",),
    "stage": ("routing", "chunk_predictions", "prediction", "timing"),
    "ocr": ("document_meta", "ocr_summary", "chunks"),
}
# -------------------------------------------------------------------------------------------


def ordered_distinct(
    df: DataFrame, unit: Sequence[str], array: str, order: Sequence[str], alias: str
) -> DataFrame:
    """Distinct array values per unit in first-seen order, reduced before collecting."""
    rows = df.select(
        *unit, F.struct(*order).alias("at"), posexplode(array).alias("i", "v")
    ).filter(F.col("v").isNotNull())
    firsts = rows.groupBy(*unit, "v").agg(F.min(F.struct("at", "i")).alias("pos"))
    collected = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return firsts.groupBy(*unit).agg(F.transform(collected, lambda s: s["v"]).alias(alias))


def batch_summary(batches: DataFrame, unit: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per batch: its label, scores, routes and relation count."""
    return batches.select(
        *unit,
        "batch_index",
        F.concat(F.lit("batch-"), F.col("batch_index")).alias("batch_key"),
        "split_mode",
        "section_ids",
        "scores",
        F.size("relations").alias("relation_count"),
    )


def rollup_batches(batches: DataFrame, unit: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: skills in first-seen order, cache flag, batch and relation counts.

    The per-batch detail stays a table of rows (:func:`batch_summary`); what is collected
    here is bounded by the number of skills.
    """
    unit = list(unit)
    totals = batches.groupBy(*unit).agg(
        F.count("*").alias("batch_count"),
        F.sum(F.size("relations")).alias("relation_count"),
        F.bool_and(F.coalesce("cache_hit", F.lit(False))).alias("cache_hit"),
    )
    out = totals
    for column in ("selected_skills", "document_selected_skills"):
        out = out.join(
            ordered_distinct(batches, unit, column, ("batch_index",), column), unit, "left"
        )
    empty = F.array().cast("array<string>")
    return out.select(
        *unit,
        "batch_count",
        "relation_count",
        F.coalesce("cache_hit", F.lit(True)).alias("cache_hit"),
        F.coalesce("selected_skills", empty).alias("selected_skills"),
        F.coalesce("document_selected_skills", empty).alias("document_selected_skills"),
    )


def with_empty_documents(rollup: DataFrame, documents: DataFrame, unit: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add documents without any batch; the cache flag over zero batches is true."""
    joined = documents.select(*unit).join(rollup, list(unit), "left")
    return joined.withColumns(
        {
            "batch_count": F.coalesce("batch_count", F.lit(0)),
            "relation_count": F.coalesce("relation_count", F.lit(0)),
            "cache_hit": F.coalesce("cache_hit", F.lit(True)),
        }
    )


def sum_metrics(results: DataFrame, unit: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Timing sums (4 decimals) and count sums per unit; missing values count as zero."""
    zero = F.lit(0)
    return results.groupBy(*unit).agg(
        *[F.round(F.sum(F.coalesce(F.col(c), zero)), 4).alias(c) for c in TIMINGS],
        *[F.sum(F.coalesce(F.col(c), zero)).alias(c) for c in COUNTS],
    )


def _counts(df: DataFrame, unit: Sequence[str], alias: str) -> DataFrame:
    return df.groupBy(*unit).agg(F.count("*").alias(alias))


def document_summary(
    documents: DataFrame,
    chunks: DataFrame,
    sections: DataFrame,
    batches: DataFrame,
    relations: DataFrame,
    unit: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Counts per document; each table is aggregated before it is joined."""
    unit = list(unit)
    out = documents.select(
        *unit,
        "page_count",
        "ocr_restructure_fallback",
        F.char_length("document_text").alias("document_text_length"),
        "selected_skills",
    )
    named = {
        "chunk_count": chunks,
        "relation_section_count": sections,
        "relation_batch_count": batches,
        "relation_count": relations,
    }
    for alias, table in named.items():
        out = out.join(_counts(table, unit, alias), unit, "left").withColumn(
            alias, F.coalesce(F.col(alias), F.lit(0))
        )
    return out


def run_summary(
    samples: DataFrame, relations: DataFrame, unit: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Per sample: skills, relation count, seconds."""
    unit = list(unit)
    counted = samples.join(_counts(relations, unit, "relation_count"), unit, "left")
    return counted.select(
        *unit,
        F.array_join("selected_skills", ",").alias("skills"),
        F.coalesce("relation_count", F.lit(0)).alias("relation_count"),
        "total_seconds",
        "sample_wall_seconds",
    )


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("sample_count"),
        F.sum("relation_count").alias("relation_count"),
        F.round(F.sum("total_seconds"), 4).alias("total_seconds"),
        F.round(F.sum("sample_wall_seconds"), 4).alias("total_wall_seconds"),
    )


def result_view(results: DataFrame, kind: str, keep: Sequence[str] = ("task_id",)) -> DataFrame:
    """Projection of document results for display: ``final``, ``stage`` or ``ocr``."""
    return results.select(*keep, *VIEWS[kind])


def order_fields(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Relation fields first in their fixed order, everything else behind."""
    known = [c for c in FIELD_ORDER if c in df.columns]
    return df.select(*keep, *known, *[c for c in df.columns if c not in (*keep, *known)])
