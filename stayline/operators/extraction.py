"""Parsing of model answers: first JSON object, validation status, run summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.times import label_time_text, lenient_time
from stayline.functions.typing import as_double, blank_to_null, lenient_bool, round6
from stayline.operators.scale import computed_once

ANSWER_KEYS = ("suspected_sepsis", "suspicion_time", "infection_source", "evidence_span", "confidence")


def first_json_object(text: Column) -> Column:
    """Members of the first JSON object in free text, as a map of texts; NULL without one.

    The text is cut before every brace that may open an object.  The built-in parser tries
    the pieces' places in turn; it stops at the object's end, so what follows is no matter,
    and no further place is tried once an object is found.  An object inside a broken one
    counts.  A repeated name has all its values: ``member`` takes the last.
    """
    strict = {"allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}
    members = "map<string,string>"

    def tried(state: Column, piece: Column) -> Column:
        opened = state["found"].isNull() & piece.startswith("{")
        found = F.when(opened, F.from_json(F.substr(text, state["at"]), members, strict))
        return F.struct(F.coalesce(state["found"], found).alias("found"), (state["at"] + F.length(piece)).alias("at"))

    start = F.struct(F.lit(None).cast(members).alias("found"), F.lit(1).alias("at"))
    return F.aggregate(F.split(text, r'(?=\{[ \t\n\r]*["}])'), start, tried, lambda state: state["found"])


def member(members: Column, name: str) -> Column:
    """Value of a name in a map from ``first_json_object``: the last one given."""
    named = F.filter(F.map_entries(members), lambda entry: entry["key"] == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def parsed_answers(answers: DataFrame, text: str = "raw_response_text") -> DataFrame:
    """Add ``extraction_status``, ``error_kind`` and the ``normalized_extraction`` struct.

    Checks run in the order JSON, keys, boolean, time, confidence, label contract.  A
    missing object is a parse error, a missing key or a broken contract a schema error,
    an unreadable value a request error.
    """
    fields = answers.withColumn("_map", first_json_object(F.col(text)))

    def raw(key: str) -> Column:
        return member(F.col("_map"), key)

    missing = F.lit(False)
    for key in ANSWER_KEYS:
        missing = missing | ~F.map_contains_key("_map", key)
    staged = computed_once(fields).withColumns(
        {
            "_missing": missing,
            "_positive": lenient_bool(raw("suspected_sepsis")),
            "_time": label_time_text(raw("suspicion_time")),
            "_bad_time": blank_to_null(raw("suspicion_time")).isNotNull()
            & lenient_time(raw("suspicion_time")).isNull(),
            "_source": blank_to_null(raw("infection_source")),
            "_evidence": blank_to_null(raw("evidence_span")),
            "_confidence": as_double(raw("confidence")),
        }
    )
    staged = computed_once(staged)
    broken = F.col("_positive") & (
        F.col("_time").isNull() | F.col("_source").isNull() | F.col("_evidence").isNull()
    )
    error = (
        F.when(F.col("_map").isNull(), F.lit("no_json_object"))
        .when(F.col("_missing"), F.lit("missing_keys"))
        .when(F.col("_positive").isNull(), F.lit("unreadable_boolean"))
        .when(F.col("_bad_time"), F.lit("unreadable_time"))
        .when(
            F.col("_confidence").isNull() | ~F.col("_confidence").between(0.0, 1.0),
            F.lit("unreadable_confidence"),
        )
        .when(broken, F.lit("positive_without_details"))
    )
    status = (
        F.when(F.col("error_kind").isNull(), F.lit("ok"))
        .when(F.col("error_kind") == "no_json_object", F.lit("parse_error"))
        .when(F.col("error_kind").isin("missing_keys", "positive_without_details"), F.lit("schema_error"))
        .otherwise(F.lit("request_error"))
    )
    normalized = F.struct(
        F.col("_positive").alias("suspected_sepsis"),
        F.when(F.col("_positive"), F.col("_time")).alias("suspicion_time"),
        F.when(F.col("_positive"), F.col("_source")).alias("infection_source"),
        F.when(F.col("_positive"), F.col("_evidence")).alias("evidence_span"),
        round6(F.col("_confidence")).alias("confidence"),
    )
    return (
        staged.withColumn("error_kind", error)
        .withColumn("extraction_status", status)
        .withColumn("normalized_extraction", F.when(F.col("error_kind").isNull(), normalized))
        .drop("_map", "_missing", "_positive", "_time", "_bad_time", "_source", "_evidence", "_confidence")
    )


def extraction_summary(results: DataFrame, by: Sequence[str] = ("model_slot", "model_id")) -> DataFrame:
    """Result, ok and error counts and mean latency per model."""
    ok = F.count_if(F.col("extraction_status") == "ok")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("result_count"),
        ok.alias("ok_count"),
        (F.count(F.lit(1)) - ok).alias("error_count"),
        round6(F.avg("latency_seconds")).alias("average_latency_seconds"),
    )
