"""Causal stage: every dataset through the same preprocessing, weighting and survival fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.functions.typing import round6
from stayline.operators import causal as ca, checks as ck, evaluate as ev
from stayline.operators.datasets import DATASET_COLUMNS, SHIFT_COLUMNS
from stayline.plans import fixed_values as fv
from stayline.plans.study import Tables, covariates
from stayline.session import cut_lineage

FULL, SUBSET = "full_cohort", "disagreement_subset"
WEIGHTINGS = {
    "primary": "stabilized_weight_primary",
    "sensitivity": "stabilized_weight_sensitivity",
    "overlap": "overlap_weight",
}


class EstimationFailed(ca.ConvergenceError):
    """Some datasets failed; ``results`` has everything up to the robustness step."""

    def __init__(self, message: str, results: dict[str, DataFrame]):
        super().__init__(message)
        self.results = results


def _identified(primary: DataFrame, shifted: DataFrame | None) -> DataFrame:
    """Primary and shifted datasets in one frame with their provenance columns."""
    ck.same_schema("primary datasets", primary.columns, [c for c in DATASET_COLUMNS if c in primary.columns])
    provenance = {
        "source_predictor_name": F.lit(None).cast("string"),
        "source_predictor_type": F.lit(None).cast("string"),
        "source_predictor_id": F.lit(None).cast("string"),
        "shift_hours": F.lit(None).cast("double"),
    }
    out = primary.withColumns(provenance)
    if shifted is None:
        return out
    ck.same_schema("shifted datasets", shifted.columns, primary.columns, SHIFT_COLUMNS)
    moved = shifted.withColumns(
        {
            "source_predictor_name": F.col("synthetic_source_predictor_name"),
            "source_predictor_type": F.col("synthetic_source_predictor_type"),
            "source_predictor_id": F.col("synthetic_source_predictor_id"),
            "shift_hours": F.col("synthetic_shift_hours"),
        }
    ).drop(*SHIFT_COLUMNS)
    return out.unionByName(moved)


def _aligned(primary: DataFrame) -> None:
    """All primary datasets cover the same tasks with the same identities."""
    names = primary.select("predictor_name").distinct().count()
    per_task = primary.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("predictor_name").alias("predictors"),
        F.count_distinct(F.struct("subject_id", "hadm_id", "stay_id")).alias("identities"),
    )
    ck.enforce(
        ck.count_where(per_task, "task_not_in_all_datasets", F.col("predictors") != names),
        ck.count_where(per_task, "duplicate_task", F.col("rows") != F.col("predictors")),
        ck.count_where(per_task, "identity_mismatch", F.col("identities") != 1),
    )


def causal_stage(
    primary: DataFrame,
    tables: Tables,
    shifted: DataFrame | None = None,
    *,
    max_weight: float = ca.MAX_WEIGHT,
    severe_overlap_width: float = ca.SEVERE_OVERLAP_WIDTH,
) -> dict[str, DataFrame]:
    """Detail rows, survival curves, one summary row per dataset and scope, robustness.

    Full cohorts of all primary datasets, their disagreement subsets when two or more
    models are there, and all shifted datasets.  A dataset that fails has a summary row with
    its reason and no detail or curve rows; all are listed before the run stops with
    ``EstimationFailed``, which carries detail, curves and summary.
    """
    _aligned(primary)
    everything = _identified(primary, shifted)
    # one pass over the event tables for all datasets; everything below reads this frame
    rows = cut_lineage(covariates(everything, tables))
    rows = rows.withColumns(
        {
            "treatment": F.col("early_antibiotic_within_window"),
            "event": F.col("mortality_28d"),
        }
    )
    is_primary = F.col("predictor_type") != "synthetic"
    eligible = rows.where("analysis_eligible")
    ck.enforce(ck.missing_values(eligible, fv.COVARIATES, "missing_covariate_"))

    kinds = {
        r["predictor_name"]: r
        for r in rows.select(
            "predictor_name", "predictor_type", "predictor_id", "source_predictor_name",
            "source_predictor_type", "source_predictor_id", "shift_hours",
        ).distinct().collect()
    }
    primaries = sorted(n for n, r in kinds.items() if r["predictor_type"] != "synthetic")
    reference = "gold" if "gold" in primaries else primaries[0]
    design = ca.fit_preprocessing(
        eligible.where(F.col("predictor_name") == reference), eligible.where(is_primary),
        fv.CONTINUOUS_COVARIATES, fv.CATEGORICAL_COVARIATES, fv.BINARY_COVARIATES,
    )
    columns = design.columns()
    features = [f"x{i}" for i in range(len(columns))]

    models = [n for n in primaries if kinds[n]["predictor_type"] == "model"]
    scoped = rows.withColumn("analysis_scope", F.lit(FULL))
    if len(models) >= 2:
        disagreeing = ev.material_disagreement(rows.where(is_primary), models).select("task_id")
        subset = rows.where(is_primary).join(disagreeing, "task_id", "left_semi")
        scoped = scoped.unionByName(subset.withColumn("analysis_scope", F.lit(SUBSET)))
    scoped = scoped.withColumn("dataset", F.concat_ws("|", "predictor_name", "analysis_scope"))
    sizes = {
        r["dataset"]: r
        for r in scoped.groupBy("dataset", "predictor_name", "analysis_scope").agg(
            F.count(F.lit(1)).alias("input_row_count"),
            F.count_if("analysis_eligible").alias("analysis_row_count"),
        ).collect()
    }
    ready = cut_lineage(scoped.where("analysis_eligible").select("*", *columns))
    verdicts = {r["dataset"]: r["verdict"] for r in ca.estimation_guards(ready).collect()}
    status = {d: verdicts.get(d) if r["analysis_row_count"] else "no_eligible_rows" for d, r in sizes.items()}
    _, unfit, scored = ca.fit_propensities(ready, features, datasets=[d for d in sorted(sizes) if not status[d]])
    status |= unfit
    weighted = cut_lineage(ca.truncated_weights(ca.raw_weights(cut_lineage(scored.drop(*features)))))
    guarded = ca.estimation_guards(weighted, weight="stabilized_weight_primary", max_weight=max_weight)
    for r in guarded.where("verdict IS NOT NULL").collect():
        status[r["dataset"]] = r["verdict"]
    fine = [d for d, why in status.items() if not why]
    weighted = weighted.where(F.col("dataset").isin(*fine))

    failures: dict[tuple[str, str], str] = {}
    hazard = ca.weighted_hazard_ratios(weighted, WEIGHTINGS, failures=failures)
    for (dataset, weighting), why in sorted(failures.items(), reverse=True):  # the first by name stays
        status[dataset] = f"{weighting}: {why}"
    curves = ca.weighted_survival(weighted, weight="stabilized_weight_primary")
    summary = _summary(rows.sparkSession, weighted, hazard, sizes, status, kinds, severe_overlap_width)
    detail = weighted.select(
        *[
            {
                "dataset_name": F.col("predictor_name").alias("dataset_name"),
                "dataset_type": F.col("predictor_type").alias("dataset_type"),
                "dataset_id": F.col("predictor_id").alias("dataset_id"),
                "treatment": F.col("treatment").cast("int").alias("treatment"),
                "event": F.col("event").cast("int").alias("event"),
            }.get(c, F.col(c))
            for c in fv.DETAIL_COLUMNS
        ]
    )
    results = {"detail": detail, "curves": curves, "summary": summary}
    failed = {d: why for d, why in status.items() if why}
    if failed:
        raise EstimationFailed("; ".join(f"{d}: {why}" for d, why in sorted(failed.items())), results)
    bias, stability, trend = ca.robustness(summary)
    return {**results, "bias": bias, "stability": stability, "trend": trend}


def _summary(spark, weighted, hazard, sizes, status, kinds, severe_width) -> DataFrame:
    """One row per dataset and scope in the fixed column order (small frames only)."""
    ratios = hazard.groupBy("dataset").agg(
        *[
            F.max(F.when(F.col("weighting") == w, round6(F.col(source)))).alias(f"{w}_{name}")
            for w in WEIGHTINGS
            for name, source in (("hr", "hr"), ("ci_lower", "ci_lower"), ("ci_upper", "ci_upper"))
        ]
    )
    counts = weighted.groupBy("dataset").agg(
        F.count_if(F.col("treatment").cast("int") == 1).alias("treated_count"),
        F.count_if(F.col("treatment").cast("int") == 0).alias("control_count"),
        F.count_if(F.col("event").cast("int") == 1).alias("event_count"),
    )
    known = spark.createDataFrame(
        [
            (
                dataset, r["predictor_name"], k["predictor_type"], k["predictor_id"], r["analysis_scope"],
                k["source_predictor_name"], k["source_predictor_type"], k["source_predictor_id"], k["shift_hours"],
                r["input_row_count"],
                r["analysis_row_count"] if not status[dataset] else 0,
                r["input_row_count"] - (r["analysis_row_count"] if not status[dataset] else 0),
                f"failed:{status[dataset]}" if status[dataset] else "ok",
            )
            for dataset, r in sizes.items()
            for k in (kinds[r["predictor_name"]],)
        ],
        "dataset string, dataset_name string, dataset_type string, dataset_id string, analysis_scope string, "
        "source_predictor_name string, source_predictor_type string, source_predictor_id string, "
        "synthetic_shift_hours double, input_row_count bigint, analysis_row_count bigint, "
        "excluded_row_count bigint, convergence_status string",
    )
    overlap = ca.overlap_summary(weighted, severe_width=severe_width)
    out = known
    for part in (counts, ratios, overlap, ca.weight_summary(weighted)):
        out = out.join(part, "dataset", "left")
    slug = F.concat_ws("_", "dataset_name", "analysis_scope")
    out = out.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("treated_count", "control_count", "event_count")},
            "severe_overlap_flag": F.coalesce("severe_overlap_flag", F.lit(False)),
            "detail_csv_path": F.concat(F.lit("causal_detail_"), slug, F.lit(".csv")),
            "survival_curve_csv_path": F.concat(F.lit("survival_curve_"), slug, F.lit(".csv")),
        }
    )
    rounded = {
        f.name for f in out.schema.fields
        if f.dataType.simpleString() == "double" and f.name != "synthetic_shift_hours"
    }
    return out.select(*[round6(F.col(c)).alias(c) if c in rounded else F.col(c) for c in fv.SUMMARY_COLUMNS])
