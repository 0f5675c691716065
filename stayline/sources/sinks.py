"""Writers: Parquet, CSV with a fixed header, JSON lines, one output per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from stayline.functions.text import file_safe
from stayline.functions.times import time_text


def to_silver(df: DataFrame, path: str, keys: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Write a typed table once as Parquet, distributed by its join keys.

    Sorting inside files by item and time lets later scans skip row groups.  A key with
    very many rows is split by adaptive execution while writing (``rebalance``).
    """
    spread = df.hint("rebalance", *keys)
    ordered = spread.sortWithinPartitions(*sort) if sort else spread
    write_parquet(ordered, path)


def even_over(df: DataFrame, keys: Sequence[str], buckets: int) -> bool:
    """Whether no key has more rows than an average bucket: one bucket is one task's work."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    rows, most = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    return not rows or most <= max(rows / buckets, 1)


def to_buckets(df: DataFrame, name: str, path: str, keys: Sequence[str], sort: Sequence[str], buckets: int) -> None:
    """Write a typed table as the bucketed table ``name`` with its files under ``path``.

    Rows are dealt by the buckets' own hash first, so every bucket is one file.  Joins and
    aggregations on the keys then need no shuffle of this table.
    """
    spread = df.repartition(buckets, *keys)
    writer = spread.write.mode("overwrite").format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, *keys).sortBy(*keys, *sort).saveAsTable(name)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def flat_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns in a fixed order as CSV can hold them: lists joined, times to the second."""
    out = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in columns or df.columns:
        kind = types[name]
        if isinstance(kind, T.ArrayType):
            out.append(F.array_join(name, "|").alias(name))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            out.append(time_text(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> None:
    """CSV with a header in the given column order, optionally sorted."""
    flat = flat_columns(df.orderBy(*order) if order else df, columns)
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_arrays(df: DataFrame, file: Column, files: int, path: str) -> None:
    """``files`` JSON files that each hold one array, of the rows (column ``row``, JSON texts)
    whose ``file`` is its number; a file without rows is not written.

    A task writes the rows of one file as they reach it: brackets and commas follow from the
    row's place in the task and the rows counted for the file before, so no task sorts or
    holds rows, and the order inside a file is not defined.
    """
    rows = df.select(file.cast("int").alias("_file"), "row")
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))  # at most one a file
    dealt = rows.join(F.broadcast(counts), "_file").repartitionById(files, "_file")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its partition
    placed = dealt.select("row", "_rows", at.alias("_at"))
    opened = F.when(F.col("_at") == 0, "[").otherwise(",")
    closed = F.when(F.col("_at") + 1 == F.col("_rows"), "]").otherwise("")
    placed.select(F.concat(opened, "row", closed).alias("value")).write.text(path)


def write_per_key(df: DataFrame, key: str, path: str, *, kind: str = "parquet") -> None:
    """One folder per key value, the key made safe for a path.

    Rows are clustered by key first, so a folder gets few files; adaptive execution splits a
    key with very many rows.
    """
    folder = f"{key}_folder"
    named = df.withColumn(folder, file_safe(F.col(key).cast("string")))
    writer = named.hint("rebalance", folder).write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.partitionBy(folder).format(kind).save(path)
