"""Library operators bound to the benchmark tables, each with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayline.session import configure


@dataclass(frozen=True)
class Bound:
    """One registered query: the Spark form and, where SQL can express it, the SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Time as text with microseconds, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def with_micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: micros(c) for c in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})
