"""Analysis datasets: treatment timing, 28-day outcome, eligibility, time-zero shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.lists import joined, listed
from stayline.functions.times import add_hours, days_between, hours_between, shift_label
from stayline.functions.typing import blank_to_null, round6

# Column order of an analysis dataset.
DATASET_COLUMNS = (
    "task_id", "subject_id", "hadm_id", "stay_id",
    "predictor_name", "predictor_type", "predictor_id",
    "suspected_sepsis", "suspicion_time", "infection_source", "evidence_span",
    "predictor_confidence", "analysis_eligible", "analysis_exclusion_reason",
    "treatment_timing_category", "early_antibiotic_within_window",
    "treatment_delay_hours", "treatment_before_time_zero",
    "death_time", "death_delay_days", "death_before_time_zero",
    "mortality_28d", "followup_duration_days", "hours_from_icu_to_time_zero",
    "admittime", "dischtime", "icu_intime", "icu_outtime",
    "study_window_start", "study_window_end",
    "first_antibiotic_time", "antibiotic_event_count",
    "first_lactate_time", "lactate_event_count",
    "first_blood_culture_time", "blood_culture_event_count",
    "anchor_age", "gender", "admission_type", "insurance", "marital_status", "race",
    "has_antibiotic_exposure", "has_lactate_measurement", "has_blood_culture",
    "signal_count",
)

# Columns a shifted dataset carries in front.
SHIFT_COLUMNS = (
    "synthetic_source_predictor_name", "synthetic_source_predictor_type",
    "synthetic_source_predictor_id", "synthetic_shift_hours",
    "original_suspicion_time", "original_analysis_eligible",
    "original_analysis_exclusion_reason",
)

FOLLOWUP_DAYS = 28.0


def to_second(ts: Column) -> Column:
    """Time cut to whole seconds, the resolution of stored artifacts."""
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def treatment_columns(zero: Column, treated_at: Column, window_hours: float) -> dict[str, Column]:
    """Treatment timing relative to time zero.

    The early-treatment flag has three states: it is NULL without a time zero and when
    treatment came before it, false for late or no treatment.
    """
    delay = hours_between(zero, treated_at)
    category = (
        F.when(zero.isNull(), F.lit("no_time_zero"))
        .when(treated_at.isNull(), F.lit("no_antibiotic"))
        .when(delay < 0, F.lit("before_time_zero"))
        .when(delay <= window_hours, F.lit("within_window"))
        .otherwise(F.lit("after_window"))
    )
    early = (
        F.when(zero.isNull() | (delay < 0), F.lit(None).cast("boolean"))
        .when(treated_at.isNull(), F.lit(False))
        .otherwise(delay <= window_hours)
    )
    return {
        "treatment_timing_category": category,
        "early_antibiotic_within_window": early,
        "treatment_delay_hours": round6(delay),
        "treatment_before_time_zero": F.coalesce(delay < 0, F.lit(False)),
    }


def outcome_columns(zero: Column, died_at: Column) -> dict[str, Column]:
    """28-day outcome and follow-up relative to time zero.

    A death before time zero leaves outcome and follow-up NULL; a later one inside the
    horizon ends follow-up, everything else is censored at the horizon.
    """
    delay = days_between(zero, died_at)
    before = F.coalesce(delay < 0, F.lit(False))
    died = F.coalesce(delay <= FOLLOWUP_DAYS, F.lit(False))
    known = zero.isNotNull() & ~before
    return {
        "death_delay_days": round6(delay),
        "death_before_time_zero": before,
        "mortality_28d": F.when(known, died),
        "followup_duration_days": F.when(
            known, F.when(died, round6(delay)).otherwise(F.lit(FOLLOWUP_DAYS))
        ),
    }


def eligibility_columns(reasons: Sequence[tuple[Column, str]]) -> dict[str, Column]:
    """Eligible iff no exclusion reason holds; reasons joined in the given order."""
    excluded = joined(listed(reasons))
    return {"analysis_eligible": excluded.isNull(), "analysis_exclusion_reason": excluded}


def _derived(df: DataFrame, window_hours: float, *, outside: Column | None = None) -> DataFrame:
    """Recompute everything that hangs on ``suspicion_time``."""
    zero = F.col("suspicion_time")
    out = df.withColumns(
        {
            **treatment_columns(zero, F.col("first_antibiotic_time"), window_hours),
            **outcome_columns(zero, F.col("death_time")),
            "hours_from_icu_to_time_zero": round6(hours_between(F.col("icu_intime"), zero)),
        }
    )
    reasons = [(zero.isNull(), "missing_time_zero")]
    if outside is not None:
        reasons.append((outside, "shifted_time_zero_outside_study_window"))
    reasons += [
        (F.col("treatment_before_time_zero"), "treatment_before_time_zero"),
        (F.col("death_before_time_zero"), "death_before_time_zero"),
    ]
    return out.withColumns(eligibility_columns(reasons))


def analysis_datasets(
    predictions: DataFrame, gold: DataFrame, cohort: DataFrame, *, window_hours: float = 3.0
) -> DataFrame:
    """All predictors' analysis rows in one long frame, in the fixed column order.

    ``gold`` gives the identity of each task (task_id, subject_id, hadm_id, stay_id),
    ``cohort`` the stay with its demographic columns and ``death_time``.  A negative
    prediction has no time zero.
    """
    carried = [
        c
        for c in DATASET_COLUMNS
        if c in cohort.columns and c not in ("task_id", "subject_id", "hadm_id", "death_time")
    ]
    rows = (
        predictions.join(gold.select("task_id", "subject_id", "hadm_id", "stay_id"), "task_id", "left")
        .join(cohort.select(*carried, "death_time"), "stay_id", "left")
        .withColumn("suspicion_time", F.when(F.col("suspected_sepsis"), to_second(F.col("suspicion_time"))))
        .withColumn("infection_source", blank_to_null(F.col("infection_source")))
        .withColumn("evidence_span", blank_to_null(F.col("evidence_span")))
        .withColumnRenamed("confidence", "predictor_confidence")
    )
    full = _derived(rows, window_hours)
    full = full.withColumn("death_time", to_second(F.col("death_time")))
    times = [
        c for c in ("admittime", "dischtime", "icu_intime", "icu_outtime", "study_window_start",
                    "study_window_end", "first_antibiotic_time", "first_lactate_time",
                    "first_blood_culture_time")
        if c in full.columns
    ]
    full = full.withColumns({c: to_second(F.col(c)) for c in times})
    return full.select(*[c for c in DATASET_COLUMNS if c in full.columns])


def dataset_summary(datasets: DataFrame) -> DataFrame:
    """Conditional counts per predictor."""
    early = F.col("early_antibiotic_within_window")
    return datasets.groupBy("predictor_name", "predictor_type", "predictor_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("suspected_sepsis").alias("suspected_sepsis_count"),
        F.count_if("analysis_eligible").alias("analysis_eligible_count"),
        F.count_if(F.col("analysis_exclusion_reason") == "missing_time_zero").alias("missing_time_zero_count"),
        F.count_if("treatment_before_time_zero").alias("treatment_before_time_zero_count"),
        F.count_if("death_before_time_zero").alias("death_before_time_zero_count"),
        F.count_if(early).alias("early_antibiotic_count"),
        F.count_if(~early).alias("delayed_or_no_antibiotic_count"),
        F.count_if("mortality_28d").alias("mortality_28d_count"),
    )


def shift_time_zero(
    datasets: DataFrame, shifts: Sequence[float], *, window_hours: float = 3.0
) -> DataFrame:
    """Shifted copies of analysis rows with all time-zero fields recomputed.

    Every row is expanded by the fixed shift list; originals are kept in the leading
    columns.  A shift of zero hours is refused.
    """
    if not shifts or any(float(s) == 0 for s in shifts):
        raise ValueError("shifts must be a non-empty list of non-zero hours")
    hours = F.col("synthetic_shift_hours")
    moved = datasets.withColumn(
        "synthetic_shift_hours", F.explode(F.array(*[F.lit(float(s)) for s in shifts]))
    ).withColumns(
        {
            "synthetic_source_predictor_name": F.col("predictor_name"),
            "synthetic_source_predictor_type": F.col("predictor_type"),
            "synthetic_source_predictor_id": F.col("predictor_id"),
            "original_suspicion_time": F.col("suspicion_time"),
            "original_analysis_eligible": F.col("analysis_eligible"),
            "original_analysis_exclusion_reason": F.col("analysis_exclusion_reason"),
        }
    )
    moved = moved.withColumns(
        {
            "suspicion_time": add_hours(F.col("original_suspicion_time"), hours),
            "predictor_name": F.concat(
                F.lit("synthetic_"), F.col("predictor_name"), F.lit("_"), shift_label(hours)
            ),
            "predictor_type": F.lit("synthetic"),
            "predictor_id": F.concat(F.col("predictor_name"), F.lit("|shift="), hours.cast("string")),
        }
    )
    outside = ~F.col("suspicion_time").between(F.col("study_window_start"), F.col("study_window_end"))
    derived = _derived(moved, window_hours, outside=F.coalesce(outside, F.lit(False)))
    derived = derived.withColumn("suspicion_time", to_second(F.col("suspicion_time")))
    return derived.select(*SHIFT_COLUMNS, *datasets.columns)


def selected_predictors(datasets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the named predictors; a name without rows is an error."""
    present = {
        row["predictor_name"]
        for row in datasets.select("predictor_name")
        .where(F.col("predictor_name").isin(*names))
        .distinct()
        .collect()
    }
    missing = sorted(set(names) - present)
    if missing:
        raise ValueError("unknown predictor(s): " + ", ".join(missing))
    return datasets.where(F.col("predictor_name").isin(*names))


def shift_summary(shifted: DataFrame) -> DataFrame:
    """Conditional counts per source predictor and shift."""
    reason = F.col("analysis_exclusion_reason")
    return shifted.groupBy(
        F.col("synthetic_source_predictor_name").alias("source_predictor_name"),
        F.col("synthetic_source_predictor_type").alias("source_predictor_type"),
        F.col("synthetic_source_predictor_id").alias("source_predictor_id"),
        F.col("synthetic_shift_hours").alias("shift_hours"),
    ).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("analysis_eligible").alias("analysis_eligible_count"),
        F.count_if(reason == "missing_time_zero").alias("missing_time_zero_count"),
        F.count_if(reason.contains("shifted_time_zero_outside_study_window")).alias(
            "shifted_outside_window_count"
        ),
        F.count_if("treatment_before_time_zero").alias("treatment_before_time_zero_count"),
        F.count_if("death_before_time_zero").alias("death_before_time_zero_count"),
        F.count_if("early_antibiotic_within_window").alias("early_antibiotic_count"),
        F.count_if("mortality_28d").alias("mortality_28d_count"),
    )
