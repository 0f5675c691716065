"""JSON array files read in splits.

A file that holds one array has no line structure to split at.  It is read as pieces that
end at closing braces, which Spark's text source cuts in parallel splits of any store.  What
a brace or quote means depends on everything before it, so each piece first tells how it
changes the state (quotes seen, braces opened in either state); running totals over the
pieces, in bounded levels (split, piece), give every piece its state.  Pieces of one element
are then joined and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayline.operators.scale import running_total
from stayline.session import cut_lineage

_PLACE = ("_file", "_split", "_at")


def _pieces(spark: SparkSession, path) -> DataFrame:
    """(file, split, place in reading order, text) of the texts before each closing brace.

    Places are the same in every scan of the files: they follow from the splits alone.
    """
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_text"),
    )


def _opened(parts: Column, first: int) -> Column:
    """Opening braces in every second part, from part ``first`` on."""
    outside = F.filter(parts, lambda _, i: i % 2 == first)
    joined = F.array_join(outside, "")
    return F.char_length(joined) - F.char_length(F.replace(joined, F.lit("{"), F.lit("")))


def json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """The objects of files that each hold one JSON array of objects, as rows of ``schema``.

    Unreadable or cut-off objects stop the read; null elements and empty arrays give no row.
    The largest object bounds what a task holds, not the file.
    """
    text = F.regexp_replace("_text", r"(?s)\\.", "")  # without escaped characters
    parts = F.split(text, '"', -1)
    counted = _pieces(spark, path).select(*_PLACE, parts.alias("_parts")).select(
        *_PLACE, ((F.size("_parts") - 1) % 2).cast("bigint").alias("_quotes"),
        _opened(F.col("_parts"), 0).alias("_outside"), _opened(F.col("_parts"), 1).alias("_inside"),
    )
    quoted = running_total(counted, ["_file"], "_at", ["_split"], {"_before": "_quotes"}, inclusive=False)
    within = F.col("_before") % 2 == 1
    closing = (F.col("_before") + F.col("_quotes")) % 2 == 0  # the brace that ends the piece stands outside quotes
    steps = cut_lineage(quoted.select(
        *_PLACE, closing.alias("_closing"),
        (F.when(within, F.col("_inside")).otherwise(F.col("_outside")) - closing.cast("int")).cast("bigint").alias("_step"),
    ))
    deep = running_total(steps, ["_file"], "_at", ["_split"], {"_depth": "_step"})
    ends = deep.withColumn("_end", (F.col("_closing") & (F.col("_depth") == 0)).cast("bigint"))
    placed = running_total(ends, ["_file"], "_at", ["_split"], {"_element": "_end"}, inclusive=False)
    elements = (
        _pieces(spark, path).join(placed.select(*_PLACE, "_element", "_end"), list(_PLACE))
        .groupBy("_file", "_element")
        .agg(F.array_sort(F.collect_list(F.struct("_split", "_at", "_text"))).alias("_all"), F.max("_end").alias("_whole"))
    )
    joined = F.concat(F.array_join(F.transform("_all", lambda p: p["_text"]), "}"), F.when(F.col("_whole") == 1, "}").otherwise(""))
    objects = elements.select(F.regexp_replace(joined, r"^[^{]*", "").alias("_json")).where("_json != ''")
    return objects.select(F.from_json("_json", schema, {"mode": "FAILFAST"}).alias("_row")).select("_row.*")
