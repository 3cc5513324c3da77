"""Readers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmill.functions.rows import inline
from relmill.functions.text import null_if_empty, safe_filename
from relmill.operators.layout import LAYOUT_SCHEMA, layout_page_array
from relmill.operators.routing import ROUTE_TYPE
from relmill.operators.skills import SKILL_SCHEMA
from relmill.plans.store import stored

# ---- fixed values: accepted suffixes and file signatures ----------------------------------
PDF_TYPE = 0
IMAGE_TYPE = 1
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
SUFFIXES = (".pdf", *IMAGE_SUFFIXES)
SIGNATURES = (
    ("255044462D", ".pdf"),
    ("89504E470D0A1A0A", ".png"),
    ("FFD8FF", ".jpg"),
    ("424D", ".bmp"),
)
WEBP_SIGNATURE = "(?s)^52494646.{8}57454250"
# -------------------------------------------------------------------------------------------
#: Lines that are counted together when a limit skips empty ones.
RANGE_LINES = 10_000
SAMPLE_SCHEMA = "sample_id string, input map<string,string>, output string"
CACHE_SCHEMA = f"doc_hash string, route {ROUTE_TYPE}, written_at timestamp"


# ---- uploads --------------------------------------------------------------------------------
def scan_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder tree with a cleaned name and a fresh task id."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    return files.withColumns(
        {
            "task_id": F.replace(F.uuid(), F.lit("-"), F.lit("")),
            "filename": safe_filename(F.element_at(F.split("path", "/"), -1)),
        }
    )


def sniffed_suffix(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(F.rlike(head, F.lit(WEBP_SIGNATURE)), ".webp")
    for signature, suffix in reversed(SIGNATURES):
        out = F.when(F.startswith(head, F.lit(signature)), suffix).otherwise(out)
    return out


def name_suffix(filename: Column) -> Column:
    """Lower-case suffix including the dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(filename, r"(?s)[^.].*(\.[^.]+)\z", 1))


def classify_files(
    df: DataFrame, filename: str = "filename", content: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """Accepted files (``stored_filename, suffix, file_type``) and rejected ones.

    A trusted suffix decides; otherwise the first bytes do, and the found suffix is
    appended to the name.
    """
    own = name_suffix(F.col(filename))
    trusted = own.isin(*SUFFIXES)
    judged = df.withColumn(
        "suffix", F.when(trusted, own).otherwise(sniffed_suffix(F.col(content)))
    )
    judged = judged.withColumns(
        {
            "stored_filename": F.when(trusted, F.col(filename)).otherwise(
                F.concat(F.col(filename), F.col("suffix"))
            ),
            "file_type": F.when(F.col("suffix") == ".pdf", PDF_TYPE).when(
                F.col("suffix").isin(*IMAGE_SUFFIXES), IMAGE_TYPE
            ),
        }
    )
    known = F.col("suffix").isNotNull()
    return judged.filter(known), judged.filter(~known).drop("suffix", "stored_filename", "file_type")


# ---- samples --------------------------------------------------------------------------------
def number_lines(lines: DataFrame, alias: str) -> DataFrame:
    """Global 0-based line numbers without a global sort.

    The ids that a scan gives to its rows are consecutive inside an input split, so a row's
    rank in its split is a difference. Only the counts of the splits are ordered and summed;
    they are written, so that the planner knows their size and sends them to all tasks while
    that is below its limit for broadcasts.
    """
    split = ("_file", "_start")
    counts = lines.groupBy(*split).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first")
    )
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        lines.join(stored(offsets.drop("_n")), list(split))
        .withColumn(alias, F.col("_offset") + F.col("_row") - F.col("_first"))
        .drop("_offset", "_first")
    )


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered JSON lines with the parsed sample in ``_s``; its ``_bad`` holds a line that is no JSON object."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    read = F.from_json("value", f"{SAMPLE_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return number_lines(raw, "sample_index").withColumn("_s", read)


def bad_samples(spark: SparkSession, path: str) -> DataFrame:
    """``sample_index, line``: the lines that :func:`scan_samples` leaves out because they don't parse."""
    return sample_lines(spark, path).filter("_s._bad IS NOT NULL").select("sample_index", F.col("_s._bad").alias("line"))


def scan_samples(
    spark: SparkSession, path: str, limit: int | None = None, skip_empty: bool = False
) -> DataFrame:
    """JSON lines → ``sample_index, sample_id, input_meta, doc_text``.

    ``limit`` keeps the first lines; with ``skip_empty`` empty documents are dropped and do
    not count towards it, while ``sample_index`` stays the line number. Lines that don't
    parse are left to :func:`bad_samples`.
    """
    parsed = sample_lines(spark, path).filter("_s._bad IS NULL").select(
        "sample_index",
        "_s.sample_id",
        F.coalesce("_s.input", F.create_map().cast("map<string,string>")).alias("input_meta"),
        F.coalesce("_s.output", F.lit("")).alias("doc_text"),
    )
    if skip_empty:
        parsed = parsed.filter("doc_text != ''")
    if limit is None:
        return parsed
    if not skip_empty:
        return parsed.filter(F.col("sample_index") < limit)
    # the rows come in order, dealt by ranges instead of through one task
    return parsed.filter(F.col("sample_index") <= _last_index(parsed, limit)).orderBy("sample_index")


def _last_index(parsed: DataFrame, limit: int) -> int:
    """The index of row ``limit`` of ``parsed`` in order of ``sample_index``, or of its last; -1 if there is none.

    Rows are counted in ranges of indices; only in the range that holds the wanted row are
    indices sorted, and no texts anywhere.
    """
    width = F.lit(RANGE_LINES)
    counts = parsed.groupBy(F.floor(F.col("sample_index") / width).alias("_range")).agg(
        F.count("*").alias("_n"), F.max("sample_index").alias("_last")
    )
    total = F.sum("_n").over(Window.orderBy("_range"))
    reached = stored(counts.withColumn("_total", total))
    border = reached.filter(F.col("_total") >= limit).orderBy("_range").first()
    if limit <= 0:
        return -1
    if border is None:
        last = reached.agg(F.max("_last")).first()[0]
        return -1 if last is None else last
    inside = parsed.filter(F.floor(F.col("sample_index") / width) == border["_range"]).select("sample_index")
    rank = limit - (border["_total"] - border["_n"])
    return inside.orderBy("sample_index").limit(rank).agg(F.max("sample_index")).first()[0]


# ---- skills ---------------------------------------------------------------------------------
def list_skills(spark: SparkSession, path: str) -> DataFrame:
    """All skill files with their ``_meta`` (file name, path, time, size)."""
    files = (
        spark.read.schema(SKILL_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    return files.withColumn(
        "_meta",
        F.struct(
            F.col("_metadata.file_name").alias("filename"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("updated_at"),
            F.col("_metadata.file_size").alias("size"),
        ),
    )


def get_skill(spark: SparkSession, path: str, name: str) -> DataFrame:
    return list_skills(spark, path).filter(F.col("name") == name)


def scan_skills(spark: SparkSession, path: str) -> DataFrame:
    """Registry in file-name order; ``skill_ord`` breaks every later tie."""
    order = Window.orderBy("_meta.path")
    return (
        list_skills(spark, path)
        .withColumn("skill_ord", F.row_number().over(order) - 1)
        .drop("_meta")
    )


def registry_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return list_skills(spark, path).select(
        "_meta.filename", F.col("_meta.updated_at").alias("modified"), "_meta.size"
    )


# ---- layout results and route cache -----------------------------------------------------------
def read_layouts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw layout results, one row per document, ``doc_id`` being the file name stem."""
    raw = (
        spark.read.schema(f"doc_id string, {LAYOUT_SCHEMA}")
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*\z", "")
    return raw.withColumn("doc_id", F.coalesce(null_if_empty(F.col("doc_id")), stem))


def layout_page_rows(layouts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return layouts.select(*keep, inline(layout_page_array()))


def scan_layout_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Page rows of layout results in either shape."""
    return layout_page_rows(read_layouts(spark, path, multi_line))


def latest_routes(cache: DataFrame) -> DataFrame:
    """Newest route per text hash."""
    return cache.groupBy("doc_hash").agg(F.max_by("route", "written_at").alias("route"))


def read_route_cache(spark: SparkSession, path: str) -> DataFrame:
    """Route cache (append-only Parquet, newest row per hash); empty when there is none."""
    try:
        return latest_routes(spark.read.schema(CACHE_SCHEMA).parquet(path))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA).drop("written_at")
