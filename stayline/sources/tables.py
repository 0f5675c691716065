"""Readers for raw text tables, task bundles, label files and manifests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stayline.functions.text import lowered
from stayline.operators.checks import ContractError, require_columns
from stayline.session import cut_lineage
from stayline.sources.arrays import json_array

# The columns of the task and extraction files.
TASK_SCHEMA = (
    "task_id string, subject_id bigint, hadm_id bigint, stay_id bigint, note_count bigint, "
    "first_note_time string, last_note_time string, "
    "notes array<struct<note_id: string, charttime: string, text: string>>, "
    "annotation_template struct<suspected_sepsis: boolean, suspicion_time: string, "
    "infection_source: string, evidence_span: string, confidence: double>, annotation_status string"
)

EXTRACTION_SCHEMA = (
    "task_id string, subject_id bigint, hadm_id bigint, stay_id bigint, model_slot string, "
    "model_id string, prompt_version string, extraction_status string, error_detail string, "
    "latency_seconds double, usage_total_tokens bigint, raw_response_text string, "
    "normalized_extraction struct<suspected_sepsis: boolean, suspicion_time: string, "
    "infection_source: string, evidence_span: string, confidence: double>"
)


def text_table(
    spark: SparkSession, path: str | Sequence[str], required: Iterable[str] = (), *, multiline: bool = False
) -> DataFrame:
    """Compressed CSV with a header, every column as text.

    A gzip file is read by one task; convert it once with ``sinks.to_silver``.
    ``multiline`` is for note tables whose text holds line breaks.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    df = reader.option("multiLine", multiline).csv(path)
    return require_columns(df, required, str(path))


def note_table(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """Linked notes from Parquet, checked for the columns a stage needs."""
    return require_columns(spark.read.parquet(path), required, path)


def numbered(scan: DataFrame, number: str = "row_number", *, first: int = 1, path: str = "source_path") -> DataFrame:
    """A file scan with each row's file and its number in that file.

    Rows are counted per split of a file; running totals over the splits give each its first
    number.  Inside a split rows are numbered as they are read, so nothing is sorted and only
    one row per split is shuffled.
    """
    placed = scan.select(
        "*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = placed.groupBy(path, "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(path).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(path, "_split", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # written once, so Spark sees how few they are
    joined = placed.join(cut_lineage(starts), [path, "_split"])
    return joined.select(*scan.columns, path, (F.col("_at") + F.col("_shift") + first).alias(number))


def task_bundles(spark: SparkSession, path: str, *, first: int | None = None) -> DataFrame:
    """Task bundles from JSON lines; blank lines are skipped.

    ``first`` keeps that many tasks, in the order of file names and lines.
    """
    tasks = spark.read.schema(TASK_SCHEMA).option("mode", "FAILFAST").json(path)
    if first is None:
        return tasks.where(F.col("task_id").isNotNull())
    lines = numbered(tasks).where(F.col("task_id").isNotNull())
    return lines.orderBy("source_path", "row_number").limit(first).select(*tasks.columns)


def model_outputs(spark: SparkSession, path: str | Sequence[str], *, array: bool = False) -> DataFrame:
    """Extraction rows, from JSON lines or (``array``) from files that hold one JSON array."""
    if array:
        return json_array(spark, path, EXTRACTION_SCHEMA)
    return spark.read.schema(EXTRACTION_SCHEMA).json(path)


def label_files(spark: SparkSession, paths: Sequence[str], required: Iterable[str]) -> DataFrame:
    """Label CSVs read together, each row with the file it came from and its number there
    (the header is row 1).

    The column order may differ between files, so files with different headers are read
    apart and united by name.
    """
    frames = [numbered(text_table(spark, path, required, multiline=True), first=2) for path in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def analysis_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Analysis dataset CSVs with per-column coercion; unreadable values become NULL."""
    from stayline.functions.typing import lenient_bool, typed

    raw = text_table(spark, path, multiline=True)
    # The columns of the dataset files by type.
    kinds = {
        **{c: "bigint" for c in ("subject_id", "hadm_id", "stay_id")},
        **{c: "double" for c in ("followup_duration_days", "anchor_age", "treatment_delay_hours",
                                 "death_delay_days", "hours_from_icu_to_time_zero",
                                 "synthetic_shift_hours")},
        **{c: "timestamp_ntz" for c in ("suspicion_time", "admittime", "dischtime", "icu_intime",
                                        "icu_outtime", "study_window_start", "study_window_end",
                                        "first_antibiotic_time", "death_time", "original_suspicion_time")},
    }
    flags = ("suspected_sepsis", "analysis_eligible", "early_antibiotic_within_window",
             "mortality_28d", "treatment_before_time_zero", "death_before_time_zero",
             "original_analysis_eligible")
    out = typed(raw, {c: k for c, k in kinds.items() if c in raw.columns})
    return out.withColumns({c: lenient_bool(F.col(c)) for c in flags if c in out.columns})


def column_set(df: DataFrame) -> set[str]:
    """Lower-case column names; the header or schema only, no rows."""
    return {c.lower() for c in df.columns}


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """Typed table without rows, standing in for a source that is switched off."""
    return spark.createDataFrame([], schema)


def discovered_files(spark: SparkSession, root: str, names: dict[str, str]) -> DataFrame:
    """First path per wanted file name under a root: (file_key, path).

    Only paths are listed; file contents are not read.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    )
    keys = F.create_map(*[F.lit(v) for key, name in names.items() for v in (name, key)])
    return (
        listing.withColumn("file_key", F.element_at(keys, F.col("name")))
        .where(F.col("file_key").isNotNull())
        .groupBy("file_key")
        .agg(F.min("path").alias("path"))
    )


def discovered_folders(spark: SparkSession, root: str, word: str) -> DataFrame:
    """Folders below a root with files and a name that contains ``word``."""
    parts = F.split("path", "/")
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(parts.alias("p"))
    )
    depth = len([p for p in root.rstrip("/").split("/") if p])
    folders = F.transform(
        F.sequence(F.lit(1), F.size("p") - 1),
        lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"),
    )
    name = F.element_at(F.split("folder", "/"), -1)
    return (
        listing.select(F.explode(folders).alias("folder"))
        .where(lowered(name).contains(word) & (F.size(F.split("folder", "/")) > depth + 1))
        .distinct()
    )


def manifest_rows(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The list of structs under ``field`` of a JSON manifest, one row per entry."""
    manifest = spark.read.option("multiLine", True).json(path)
    if field not in manifest.columns:
        raise ContractError(f"{path} has no list {field!r}")
    return manifest.select(F.explode(field).alias("entry")).select("entry.*")
