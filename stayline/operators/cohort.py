"""Cohort building: linked stays, first stay per subject, signal flags, hash sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window

from stayline.functions.times import study_window


def linked_stays(
    stays: DataFrame, episodes: DataFrame, subjects: DataFrame, *, min_age: int = 18
) -> DataFrame:
    """Stays with a matching episode and an adult subject.

    Expects typed frames: stays (subject_id, hadm_id, stay_id, icu_intime, icu_outtime),
    episodes (subject_id, hadm_id, admittime, dischtime) and subjects (subject_id,
    anchor_age).
    """
    adults = subjects.where(F.col("anchor_age") >= min_age).select("subject_id", "anchor_age")
    return stays.join(
        episodes.select("subject_id", "hadm_id", "admittime", "dischtime"),
        ["subject_id", "hadm_id"],
    ).join(adults, "subject_id")


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` with NULLs last.

    The rank filter is pushed below the shuffle, so each map task sends at most one row
    per key and a hot key stays small.
    """
    window = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_stay_cohort(
    stays: DataFrame,
    episodes: DataFrame,
    subjects: DataFrame,
    *,
    min_age: int = 18,
    hours_before: float = 24,
    hours_after: float = 48,
) -> DataFrame:
    """First qualifying stay of each adult subject with its closed study window.

    The rank is taken after the joins and the age filter, so a later stay moves up when
    an earlier one has no matching episode.
    """
    first = first_per_key(
        linked_stays(stays, episodes, subjects, min_age=min_age),
        "subject_id",
        ["icu_intime", "stay_id"],
    )
    start, end = study_window(F.col("icu_intime"), hours_before, hours_after)
    return first.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "anchor_age",
        "admittime",
        "dischtime",
        "icu_intime",
        "icu_outtime",
        start.alias("study_window_start"),
        end.alias("study_window_end"),
    )


def attach_signals(
    cohort: DataFrame,
    signals: Sequence[DataFrame],
    flags: dict[str, str] | None = None,
    *,
    key: str = "stay_id",
) -> DataFrame:
    """Left-join one-row-per-stay signal tables and derive presence flags.

    ``flags`` maps a flag column to the count column that tells the signal apart from a
    stay without it; their sum becomes ``signal_count``.
    """
    out = cohort
    for signal in signals:
        out = out.join(signal, key, "left")
    if not flags:
        return out
    present = {flag: F.col(count).isNotNull() for flag, count in flags.items()}
    total = sum((p.cast("int") for p in present.values()), F.lit(0))
    return out.withColumns({**present, "signal_count": total})


def with_any_signal(cohort: DataFrame) -> DataFrame:
    """Stays with at least one signal."""
    return cohort.where(F.col("signal_count") > 0)


def hash_sample(df: DataFrame, id_columns: Sequence[str], size: int) -> DataFrame:
    """Reproducible sample: the ``size`` rows with the smallest md5 of their ids."""
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in id_columns])
    return df.orderBy(F.md5(text)).limit(size)


def cohort_summary(
    stays: DataFrame, cohort: DataFrame, candidates: DataFrame, sampled: DataFrame,
    flags: Sequence[str],
) -> DataFrame:
    """Row counts of every cohort step as (measure, rows)."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("measure"), "rows")

    by_flag = candidates.agg(*[F.count_if(F.col(f)).alias(f) for f in flags])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("measure"), F.col(f).alias("rows")) for f in flags])
    )
    return (
        counted(stays, "total_stays")
        .unionByName(counted(cohort, "adult_first_stays"))
        .unionByName(by_flag.select(pairs.alias("p")).select("p.measure", "p.rows"))
        .unionByName(counted(candidates, "candidate_cohort"))
        .unionByName(counted(sampled, "sampled_cohort"))
    )
