"""Data-quality checks: each is a small (check, violations) frame; one action enforces all."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.typing import as_long, blank_to_null


class ContractError(ValueError):
    """One or more checks found violations."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Fail when a required column is missing; reads no data."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def same_schema(
    name: str, columns: Sequence[str], reference: Sequence[str], allowed_extra: Iterable[str] = ()
) -> None:
    """Fail unless columns and their order match the reference, allow-listed extras aside."""
    extra = set(allowed_extra)
    kept = [c for c in columns if c not in extra]
    if kept != list(reference):
        raise ContractError(
            f"{name}: missing={sorted(set(reference) - set(kept))} "
            f"extra={sorted(set(kept) - set(reference))} order_differs={sorted(kept) == sorted(reference)}"
        )


def count_where(df: DataFrame, check: str, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is true, as one (check, violations) row."""
    return df.agg(F.count_if(condition).alias("violations")).select(
        F.lit(check).alias("check"), "violations"
    )


def duplicate_keys(df: DataFrame, check: str, keys: Sequence[str]) -> DataFrame:
    """Number of key values that occur more than once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return count_where(counted, check, F.col("_n") > 1)


def coverage(expected: DataFrame, found: DataFrame, check: str, key: str) -> DataFrame:
    """Keys missing from ``found`` and keys only it has, as two rows.

    One grouped pass over both key sets answers both directions.
    """
    sides = expected.select(key, F.lit(1).alias("_side")).unionByName(
        found.select(key, F.lit(2).alias("_side"))
    )
    seen = sides.groupBy(key).agg(
        F.bool_or(F.col("_side") == 1).alias("_expected"), F.bool_or(F.col("_side") == 2).alias("_found")
    )
    counts = seen.agg(
        F.count_if(F.col("_expected") & ~F.col("_found")).alias("missing"),
        F.count_if(~F.col("_expected") & F.col("_found")).alias("extra"),
    )
    rows = F.array(
        F.struct(F.lit(f"{check}_missing").alias("check"), F.col("missing").alias("violations")),
        F.struct(F.lit(f"{check}_extra").alias("check"), F.col("extra").alias("violations")),
    )
    return counts.select(F.inline(rows))


def missing_keys(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of ``expected`` that ``found`` lacks."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def identity_mismatch(
    left: DataFrame, right: DataFrame, check: str, key: str, columns: Sequence[str]
) -> DataFrame:
    """Rows whose identity columns differ between two sets (a NULL on the left is allowed)."""
    both = left.select(key, *columns).join(
        right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns]), key
    )
    differs = reduce(
        lambda a, b: a | b,
        [F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns],
    )
    return count_where(both, check, differs)


def unknown_keys(df: DataFrame, known: DataFrame, check: str, key: str) -> DataFrame:
    """Rows that refer to a key outside the known set."""
    unknown = df.join(known.select(key).distinct(), key, "left_anti")
    return count_where(unknown, check, F.lit(True))


def unparsable_integers(df: DataFrame, check: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a blank or unreadable required integer."""
    bad = reduce(
        lambda a, b: a | b,
        [blank_to_null(F.col(c)).isNull() | as_long(blank_to_null(F.col(c))).isNull() for c in columns],
    )
    return count_where(df, check, bad)


def invalid_predictions(predictions: DataFrame) -> DataFrame:
    return count_where(predictions, "invalid_prediction", F.col("prediction_status") != "ok")


def positive_without_time(predictions: DataFrame) -> DataFrame:
    return count_where(
        predictions, "positive_without_time", F.col("suspected_sepsis") & F.col("suspicion_time").isNull()
    )


def time_zero_outside_window(rows: DataFrame) -> DataFrame:
    """Time zeros outside the closed study window, or without window bounds."""
    zero, start, end = (F.col(c) for c in ("suspicion_time", "study_window_start", "study_window_end"))
    inside = F.coalesce(zero.between(start, end), F.lit(False))
    return count_where(rows, "time_zero_outside_window", zero.isNotNull() & ~inside)


def label_contract(labels: DataFrame) -> DataFrame:
    """Positive labels without time, source or evidence; negative ones with time or source."""
    positive = F.col("suspected_sepsis")
    details = [F.col(c) for c in ("suspicion_time", "infection_source", "evidence_span")]
    incomplete = positive & reduce(lambda a, b: a | b, [d.isNull() for d in details])
    spurious = ~positive & (details[0].isNotNull() | details[1].isNotNull())
    return count_where(labels, "label_contract", incomplete | spurious)


def rule_traceability(labels: DataFrame, times: Sequence[str]) -> DataFrame:
    """Rule rows whose time, confidence and source do not fit together."""
    fired = F.col("suspicion_time_rule")
    traceable = reduce(lambda a, b: a | b, [fired.eqNullSafe(F.col(t)) for t in times])
    silent = (F.col("rule_confidence") != "low") | F.col("infection_source_rule").isNotNull() | F.col(
        "infection_source_rule_source"
    ).isNotNull()
    loud = ~traceable | F.col("suspicion_time_rule_source").isNull() | ~F.col("rule_confidence").isin(
        "high", "medium"
    )
    return count_where(labels, "rule_traceability", F.when(fired.isNull(), silent).otherwise(loud))


def rejected_annotations(normalized: DataFrame) -> DataFrame:
    return count_where(normalized, "rejected_annotation", F.col("reject_reason").isNotNull())


def missing_values(df: DataFrame, columns: Sequence[str], prefix: str = "missing_") -> DataFrame:
    """NULLs per column in one pass, as (check, violations) rows."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(prefix + c).alias("check"), F.col(c).alias("violations")) for c in columns]
    )
    return counts.select(F.inline(rows))


def table_counts(tables: dict[str, DataFrame | None], distinct: dict[str, str] | None = None) -> DataFrame:
    """Rows and distinct key values per table; zeros for an absent table."""
    parts = []
    absent = []
    for name, df in tables.items():
        if df is None:
            absent.append(name)
            continue
        key = (distinct or {}).get(name)
        number = F.count_distinct(F.col(key)) if key else F.lit(0).cast("bigint")
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count"), number.alias("distinct_keys")).select(
                F.lit(name).alias("table_name"), "row_count", "distinct_keys"
            )
        )
    out = reduce(DataFrame.unionByName, parts)
    if absent:
        blank = out.sparkSession.createDataFrame([(n, 0, 0) for n in absent], out.schema)
        out = out.unionByName(blank)
    return out


def all_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def enforce(*checks: DataFrame) -> None:
    """Run all checks in one job and raise if any of them found something."""
    found = all_checks(checks).where(F.col("violations") > 0).collect()
    if found:
        raise ContractError(", ".join(f"{r['check']}={r['violations']}" for r in sorted(found)))
