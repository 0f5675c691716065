"""Predictor stacking, evaluation against gold labels, and disagreement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.text import signature
from stayline.functions.times import hours_between, seconds_between
from stayline.functions.typing import blank_to_null, round6
from stayline.operators.scale import quantile_columns

PREDICTION_FIELDS = ("suspected_sepsis", "suspicion_time", "infection_source", "evidence_span", "confidence")
PREDICTOR = ("predictor_name", "predictor_type", "predictor_id")


def as_predictor(
    rows: DataFrame, name: str, kind: str, identifier: str, *, status: Column | None = None
) -> DataFrame:
    """Rows (task_id, prediction fields) in the canonical long shape.

    The prediction fields of a row whose status is not 'ok' are emptied.
    """
    state = F.lit("ok") if status is None else F.coalesce(blank_to_null(status), F.lit("unknown"))
    return rows.select(
        "task_id",
        F.lit(name).alias("predictor_name"),
        F.lit(kind).alias("predictor_type"),
        F.lit(identifier).alias("predictor_id"),
        state.alias("prediction_status"),
        *[F.when(state == "ok", F.col(f)).alias(f) for f in PREDICTION_FIELDS],
    )


def rule_predictions(rules: DataFrame, tasks: DataFrame, stay: str = "stay_id") -> DataFrame:
    """Rule labels as predictions of the tasks on the same stay.

    Positive iff a rule time exists; evidence and confidence stay NULL.  Stays outside
    the task set are ignored.
    """
    mapped = rules.join(tasks.select("task_id", stay), stay)
    return mapped.select(
        "task_id",
        F.col("suspicion_time_rule").isNotNull().alias("suspected_sepsis"),
        F.col("suspicion_time_rule").alias("suspicion_time"),
        blank_to_null(F.col("infection_source_rule")).alias("infection_source"),
        F.lit(None).cast("string").alias("evidence_span"),
        F.lit(None).cast("double").alias("confidence"),
    )


def stacked(predictors: Sequence[DataFrame]) -> DataFrame:
    """One long predictor relation."""
    return reduce(DataFrame.unionByName, predictors)


def _rate(numerator: Column, denominator: Column) -> Column:
    return round6(F.try_divide(numerator, denominator))


def evaluate_predictors(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Evaluation summary per predictor against the gold labels.

    Invalid rows (status not 'ok') are left out of every metric but the valid rate,
    which is measured against all gold tasks.  F1 is made of the rounded precision and
    recall.
    """
    truth = gold.select(
        "task_id",
        F.col("suspected_sepsis").alias("_gold"),
        F.col("suspicion_time").alias("_gold_time"),
        signature(F.col("infection_source")).alias("_gold_source"),
    )
    ok = F.col("prediction_status") == "ok"
    compared = predictions.select(
        *PREDICTOR,
        "task_id",
        ok.alias("_ok"),
        F.when(ok, F.col("suspected_sepsis")).alias("_said"),
        F.when(ok, F.col("suspicion_time")).alias("_time"),
        F.when(ok, signature(F.col("infection_source"))).alias("_source"),
    ).join(truth, "task_id", "left")
    # a task outside the gold set has no gold class, so it counts nowhere
    valid_row = F.col("_ok") & F.col("_gold").isNotNull()
    both = valid_row & F.col("_gold") & F.col("_said")
    compared = compared.withColumn(
        "_error", F.when(both, F.abs(hours_between(F.col("_gold_time"), F.col("_time"))))
    )
    sourced = both & F.col("_gold_source").isNotNull() & F.col("_source").isNotNull()
    exact = (
        valid_row
        & (F.col("_gold") == F.col("_said"))
        & F.col("_gold_time").eqNullSafe(F.col("_time"))
        & F.col("_gold_source").eqNullSafe(F.col("_source"))
    )
    tasks = gold.agg(F.count(F.lit(1))).scalar()
    valid = F.count_if(valid_row)
    timed = F.count("_error")
    counts = compared.withColumn("_tasks", tasks).groupBy(*PREDICTOR).agg(
        F.max(F.col("_tasks")).alias("evaluated_task_count"),
        valid.alias("valid_prediction_count"),
        round6(valid / F.max("_tasks")).alias("valid_prediction_rate"),
        F.count_if(both).alias("true_positive_count"),
        F.count_if(valid_row & ~F.col("_gold") & F.col("_said")).alias("false_positive_count"),
        F.count_if(valid_row & F.col("_gold") & ~F.col("_said")).alias("false_negative_count"),
        F.count_if(valid_row & ~F.col("_gold") & ~F.col("_said")).alias("true_negative_count"),
        timed.alias("time_eval_count"),
        round6(F.avg("_error")).alias("mean_time_error_hours"),
        _rate(F.count_if(F.col("_error") <= 1.0), timed).alias("within_1h_rate"),
        _rate(F.count_if(F.col("_error") <= 3.0), timed).alias("within_3h_rate"),
        F.count_if(sourced).alias("source_eval_count"),
        _rate(F.count_if(sourced & (F.col("_gold_source") == F.col("_source"))), F.count_if(sourced)).alias(
            "infection_source_agreement_rate"
        ),
        _rate(F.count_if(exact), valid).alias("exact_label_match_rate"),
    )
    tp, fp, fn = (F.col(f"{k}_count") for k in ("true_positive", "false_positive", "false_negative"))
    scored = counts.withColumn("precision", _rate(tp, tp + fp)).withColumn("recall", _rate(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    scored = scored.withColumn("f1_score", F.when(p + r > 0, round6(2 * p * r / (p + r))))
    medians = quantile_columns(
        compared.where(F.col("_error").isNotNull()), PREDICTOR, "_error", {"median_time_error_hours": 0.5}
    )
    same = [scored[c].eqNullSafe(medians[c]) for c in PREDICTOR]
    return scored.join(medians, reduce(lambda a, b: a & b, same), "left").select(
        *[scored[c] for c in scored.columns], round6(F.col("median_time_error_hours")).alias("median_time_error_hours")
    )


def pairwise_disagreement(predictions: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Disagreement counts for every pair of the panel, in panel order.

    Classes differ; sources differ when both are present; times differ by strictly more
    than one hour when both are present.  Rates are over all shared tasks, invalid ones
    included.  Instead of joining predictions to each other, each task becomes one wide
    row and all pair counters are summed in a single pass, so no pairs are emitted.
    """
    ok = F.col("prediction_status") == "ok"
    mine = {p: F.col("predictor_name") == p for p in panel}
    wide = predictions.groupBy("task_id").agg(
        *[
            column
            for i, p in enumerate(panel)
            for column in (
                F.bool_or(F.when(mine[p], ok)).alias(f"ok{i}"),
                F.bool_or(F.when(mine[p] & ok, F.col("suspected_sepsis"))).alias(f"pos{i}"),
                F.max(F.when(mine[p] & ok, F.col("suspicion_time"))).alias(f"time{i}"),
                F.max(F.when(mine[p] & ok, signature(F.col("infection_source")))).alias(f"src{i}"),
                F.max(F.when(mine[p], F.col("predictor_id"))).alias(f"id{i}"),
            )
        ]
    )
    pairs = [(i, j) for i in range(len(panel)) for j in range(i + 1, len(panel))]
    counters = []
    for i, j in pairs:
        valid = F.col(f"ok{i}") & F.col(f"ok{j}")
        apart = F.abs(seconds_between(F.col(f"time{i}"), F.col(f"time{j}"))) > 3600
        counters += [
            F.count_if(F.col(f"ok{i}").isNotNull() & F.col(f"ok{j}").isNotNull()).alias(f"n{i}_{j}"),
            F.count_if(valid & (F.col(f"pos{i}") != F.col(f"pos{j}"))).alias(f"c{i}_{j}"),
            F.count_if(valid & (F.col(f"src{i}") != F.col(f"src{j}"))).alias(f"s{i}_{j}"),
            F.count_if(valid & apart).alias(f"t{i}_{j}"),
        ]
    ids = [F.max(f"id{i}").alias(f"id{i}") for i in range(len(panel))]
    totals = wide.agg(*counters, *ids)
    rows = F.array(
        *[
            F.struct(
                F.lit(panel[i]).alias("left_predictor"),
                F.col(f"id{i}").alias("left_predictor_id"),
                F.lit(panel[j]).alias("right_predictor"),
                F.col(f"id{j}").alias("right_predictor_id"),
                F.col(f"n{i}_{j}").alias("shared_task_count"),
                F.col(f"c{i}_{j}").alias("classification_disagreement_count"),
                _rate(F.col(f"c{i}_{j}"), F.col(f"n{i}_{j}")).alias("classification_disagreement_rate"),
                F.col(f"s{i}_{j}").alias("source_disagreement_count"),
                F.col(f"t{i}_{j}").alias("time_disagreement_over_1h_count"),
            )
            for i, j in pairs
        ]
    )
    return totals.select(F.inline(rows))


def material_disagreement(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Tasks on which the models disagree materially, with the reasons.

    Only tasks every model has count.  Classes differ, or trimmed sources differ (case
    matters, a missing source differs from a text), or some but not all times are
    missing, or the times span more than one hour.
    """
    source = F.coalesce(blank_to_null(F.col("infection_source")), F.lit(""))
    time = F.col("suspicion_time")
    span = seconds_between(F.min(time), F.max(time))
    return (
        rows.where(F.col("predictor_name").isin(*models))
        .groupBy("task_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            (F.min("suspected_sepsis") != F.max("suspected_sepsis")).alias("class_differs"),
            (F.min(source) != F.max(source)).alias("source_differs"),
            ((F.count(time) > 0) & (F.count(time) < len(models))).alias("time_partly_missing"),
            ((F.count(time) == len(models)) & (span > 3600)).alias("time_differs"),
        )
        .where(F.col("_rows") == len(models))
        .where("class_differs OR source_differs OR time_partly_missing OR time_differs")
        .drop("_rows")
    )


def shared_tasks(predictions: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Tasks that every predictor of the panel has."""
    return (
        predictions.where(F.col("predictor_name").isin(*panel))
        .select("task_id", "predictor_name")
        .distinct()
        .groupBy("task_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == len(panel))
        .select("task_id")
    )
