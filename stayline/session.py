"""Session settings the library relies on, and lineage cutting.

Only run-time SQL settings are touched, so a session made elsewhere (a cluster, a
notebook, a test) can be handed in as it is.  Shuffle partition counts are left to the
cluster's own configuration and to adaptive execution.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SQL_SETTINGS = {
    # Naive clinical times are compared as written; a fixed zone keeps the few
    # conversions that exist independent of the machine.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot subjects: split a skewed event partition over many tasks even when the
    # aggregation after the join then needs a shuffle of its (pre-aggregated) output.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Events of a cohort: where the cohort's keys are too many to broadcast, a Bloom filter of
    # them drops other events below their shuffle.  The filter's size is bounded (8 MB).
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "256MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to an existing session and return it."""
    for name, value in _SQL_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, taken from ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master, where every task runs on
    this machine; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="stayline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    Used before loops and before small per-key tables are read many times, so a lost
    executor costs a re-read and not a recomputation of the raw event scans.  Later steps
    read only the columns and rows they use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stayline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
