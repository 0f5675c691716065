"""The corpus pipeline: quality rules, quality classifier, line dedup, near-copy removal and
packing, each over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's ``docs``; ``run`` does that in the shared folder.  A stage deletes
the scratch tables of the one before it, so the disk never holds those of two stages: write
a stage's result before calling the next.  All but the last return the columns of documents.
Rows of equal ids and equal texts share every decision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.llm import bottom_k, fertility, line_index, ordinal_quality, packing
from stayline.llm.common import prepared, scratch_of, table
from stayline.llm.queries import grades
from stayline.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the tokeniser bands of their language."""
    with scratch_of(prepared(spark), "corpus pipeline"):
        return fertility.accepted(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is at least one half."""
    with scratch_of(prepared(spark), "corpus pipeline"):
        model = ordinal_quality.fit(docs, grades(table(spark, sf_dir, "labels")))
        scored = ordinal_quality.scored(docs, model, expected="grade_", tail="tail_", kept="kept_")
        return scored.where("kept_").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document holds; n_chars follows the text.

    A document that loses lines and has no word left goes: all its lines live on in smaller
    documents, as those of an exact copy do.  One that was blank before stays as it was.
    """
    with scratch_of(prepared(spark), "corpus pipeline"):
        kept = line_index.without_repeated_lines(docs, n_lines="lines_", n_dropped="dropped_")
        kept = kept.where((F.col("dropped_") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        return kept.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    with scratch_of(prepared(spark), "corpus pipeline"):
        found = bottom_k.near_duplicates(docs)
        gone = found.where("NOT kept").select(F.col("doc_id").alias("gone_")).distinct().hint("merge")  # grows with docs
        return docs.join(gone, F.col("doc_id") == F.col("gone_"), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2,048 tokens."""
    with scratch_of(prepared(spark), "corpus pipeline"):
        return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_copies),
    ("best-fit packing", best_fit_packing),
]

#: Tokenisers and a fitted model decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path, schema = f"{folder}/{at}", docs.schema
            docs.write.parquet(path)
            docs = spark.read.schema(schema).parquet(path)
    return docs
