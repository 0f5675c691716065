"""Deterministic tiered rule labels from signal columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.lists import listed
from stayline.functions.times import seconds_between


def tiered_label(
    signals: DataFrame,
    *,
    tier1: tuple[str, str],
    tier2: Sequence[tuple[str, str]],
    tier3: Sequence[tuple[str, str]],
    sources: Sequence[tuple[str, str]],
    evidence: Sequence[tuple[str, Sequence[str]]],
    high_confidence_hours: float = 6,
) -> DataFrame:
    """Rule time, confidence, source, triggers and no-fire reason per row.

    ``tier1`` / ``tier2`` / ``tier3`` hold (trigger name, time column); ``sources`` holds
    (provenance, source column) in order of precedence; ``evidence`` holds (column that
    must be set, provenance texts).

    Tier 1 wins even when a tier-2 time is earlier; otherwise the earliest tier-2 time
    counts, equal times going to the alphabetically first trigger.  Tier 3 supports but
    never fires.
    """
    name1, time1 = tier1
    note = F.col(time1)
    ordered = sorted(tier2)
    times2 = [F.col(c) for _, c in ordered]
    earliest2 = F.least(*times2) if len(times2) > 1 else times2[0]
    fired = F.coalesce(note, earliest2)

    fired_by = F.when(note.isNotNull(), F.lit(name1))
    for name, column in ordered:
        fired_by = fired_by.when(F.col(column) == earliest2, F.lit(name))

    gaps = [F.abs(seconds_between(note, t)) for t in times2]
    smallest = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    rule_confidence = (
        F.when(note.isNotNull() & (smallest <= high_confidence_hours * 3600.0), F.lit("high"))
        .when(fired.isNotNull(), F.lit("medium"))
        .otherwise(F.lit("low"))
    )

    source: Column = F.coalesce(*[F.col(c) for _, c in sources])
    source_tag = F.lit(None).cast("string")
    for tag, column in reversed(list(sources)):
        source_tag = F.when(F.col(column).isNotNull(), F.lit(tag)).otherwise(source_tag)

    supported = F.lit(False)
    for _, column in tier3:
        supported = supported | F.col(column).isNotNull()

    return signals.withColumns(
        {
            "suspicion_time_rule": fired,
            "suspicion_time_rule_source": fired_by,
            "rule_confidence": rule_confidence,
            "infection_source_rule": F.when(fired.isNotNull(), source),
            "infection_source_rule_source": F.when(fired.isNotNull(), source_tag),
            "rule_trigger": listed(
                [(F.col(c).isNotNull(), n) for n, c in [tier1, *tier2, *tier3]]
            ),
            "evidence_source": listed([(F.col(c).isNotNull(), texts) for c, texts in evidence]),
            "rule_no_fire_reason": F.when(fired.isNull() & supported, F.lit("only_tier3_supporting_signals"))
            .when(fired.isNull(), F.lit("no_tier1_or_tier2_signal")),
        }
    )


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value for several category columns: (category, label, rows), NULLs skipped."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("label")) for c in columns]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.category", "p.label")
        .where(F.col("label").isNotNull())
        .groupBy("category", "label")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def rule_summary(labels: DataFrame, triggers: Sequence[str]) -> DataFrame:
    """One row of run counts: labelled, timed, null, per trigger, with a source."""
    timed = F.col("suspicion_time_rule").isNotNull()
    return labels.agg(
        F.count(F.lit(1)).alias("labeled_row_count"),
        F.count_if(timed).alias("suspicion_time_rule_count"),
        F.count_if(~timed).alias("null_rule_count"),
        *[
            F.count_if(F.array_contains("rule_trigger", t)).alias(f"{t}_count")
            for t in triggers
        ],
        F.count_if(F.col("infection_source_rule").isNotNull()).alias("infection_source_rule_count"),
    )
