"""Reviewer assignment, annotation checks and label consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.text import evidence_lines, signature
from stayline.functions.times import label_time_text
from stayline.functions.typing import blank_to_null, confidence, lenient_bool, round6, strip
from stayline.operators.scale import computed_once, hash_positions
from stayline.session import cut_lineage

PENDING = ("", "pending", "in_progress")
SKIPPED = ("skipped", "excluded")
LABEL_FIELDS = ("suspected_sepsis", "suspicion_time", "infection_source", "evidence_span", "confidence")


def overlap_size(tasks: int, fraction: float) -> int:
    """Tasks that get a second reviewer: rounded half-even, at least one, at most all."""
    if tasks == 0 or fraction <= 0:
        return 0
    return min(tasks, round(tasks * fraction) or 1)


def assign_reviewers(
    tasks: DataFrame, reviewers: Sequence[str], *, fraction: float, seed: str, task: str = "task_id"
) -> DataFrame:
    """Balanced primary and overlapping secondary reviewers: (task, reviewer, role).

    Tasks are dealt round-robin in a reproducible hash order; the first ones of that
    order also go to a second reviewer at a rotating offset.
    """
    panel = F.array(*[F.lit(r) for r in reviewers])
    size = len(reviewers)
    overlap = overlap_size(tasks.count(), fraction)
    if overlap and size < 2:
        raise ValueError("a second review needs at least two reviewers")
    placed = hash_positions(tasks.select(task), task, seed, "_position")
    first = F.pmod("_position", F.lit(size))
    offset = F.lit(1) + F.pmod("_position", F.lit(max(1, size - 1)))
    second = F.pmod(first + offset, F.lit(size))
    roles = F.filter(
        F.array(
            F.struct(F.get(panel, first.cast("int")).alias("reviewer_id"), F.lit("primary").alias("assignment_role")),
            F.when(
                F.col("_position") < overlap,
                F.struct(
                    F.get(panel, second.cast("int")).alias("reviewer_id"),
                    F.lit("secondary").alias("assignment_role"),
                ),
            ),
        ),
        lambda r: r.isNotNull(),
    )
    return placed.select(task, F.explode(roles).alias("r")).select(
        task, "r.reviewer_id", "r.assignment_role"
    )


def assignment_counts(assignments: DataFrame, task: str = "task_id") -> DataFrame:
    """Assignments per reviewer, split by role."""
    return assignments.groupBy("reviewer_id").agg(
        F.count(F.lit(1)).alias("assignment_count"),
        F.count_if(F.col("assignment_role") == "secondary").alias("secondary_count"),
    )


def reviewer_packets(assignments: DataFrame, tasks: DataFrame, task: str = "task_id") -> DataFrame:
    """Task rows per reviewer with blank label fields, ready to be filled in."""
    blanks = {name: F.lit("") for name in (*LABEL_FIELDS, "reviewed_at")}
    return (
        assignments.join(tasks, task)
        .withColumn("annotation_status", F.lit("pending"))
        .withColumns(blanks)
    )


def expected_reviewers(assignments: DataFrame, task: str = "task_id") -> DataFrame:
    """Sorted expected reviewer ids per task."""
    return assignments.groupBy(task).agg(
        F.array_sort(F.collect_set("reviewer_id")).alias("expected_reviewer_ids")
    )


def normalized_annotations(
    rows: DataFrame,
    *,
    prefix: str = "",
    status: str | None = "annotation_status",
    reviewed: str | None = "reviewed_at",
) -> DataFrame:
    """Typed label fields, row status and rejection reason for raw label rows.

    ``row_status`` is 'pending', 'skipped' or 'completed'; a pending row with content
    counts as completed.  ``reject_reason`` is set for rows that must stop the run:
    unreadable values, a skipped row with content, or a broken label contract (a positive
    label needs time, source and evidence, a negative one must not have time or source).
    Adjudication files have no status column (``status=None``) and prefixed fields.
    """
    raw = {name: F.col(prefix + name) for name in LABEL_FIELDS}
    kept = [c for c in rows.columns if c not in {prefix + name for name in LABEL_FIELDS} | {reviewed}]
    word = F.lower(strip(F.coalesce(F.col(status), F.lit("")))) if status else F.lit("pending")
    # text first, values next, verdict last: every field is parsed once
    texts = rows.select(
        *kept,
        word.alias("_word"),
        *[blank_to_null(c).alias(f"_{name}") for name, c in raw.items()],
        *([blank_to_null(F.col(reviewed)).alias("_seen")] if reviewed else []),
    )
    values = computed_once(texts).withColumns(
        {
            "suspected_sepsis": lenient_bool(F.col("_suspected_sepsis")),
            "suspicion_time": label_time_text(F.col("_suspicion_time")),
            "infection_source": F.col("_infection_source"),
            "evidence_span": evidence_lines(F.col("_evidence_span")),
            "confidence": confidence(F.col("_confidence")),
            **({reviewed: label_time_text(F.col("_seen"))} if reviewed else {}),
        }
    )
    values = computed_once(values)
    has_content = F.coalesce(*[F.col(f"_{name}") for name in LABEL_FIELDS]).isNotNull()
    row_status = (
        F.when(F.col("_word").isin(*PENDING) & ~has_content, F.lit("pending"))
        .when(F.col("_word").isin(*SKIPPED) & ~has_content, F.lit("skipped"))
        .otherwise(F.lit("completed"))
    )
    positive, time = F.col("suspected_sepsis"), F.col("suspicion_time")
    source, evidence = F.col("infection_source"), F.col("evidence_span")
    reason = (
        F.when(~F.col("_word").isin(*PENDING, "completed"), F.lit("unsupported_status"))
        .when(positive.isNull(), F.lit("unreadable_boolean"))
        .when(F.col("_suspicion_time").isNotNull() & time.isNull(), F.lit("unreadable_time"))
        .when(F.col("confidence").isNull(), F.lit("unreadable_confidence"))
        .when(positive & time.isNull(), F.lit("positive_without_time"))
        .when(positive & source.isNull(), F.lit("positive_without_source"))
        .when(positive & evidence.isNull(), F.lit("positive_without_evidence"))
        .when(~positive & time.isNotNull(), F.lit("negative_with_time"))
        .when(~positive & source.isNotNull(), F.lit("negative_with_source"))
    )
    if reviewed:
        reason = reason.when(
            F.col("_seen").isNotNull() & F.col(reviewed).isNull(), F.lit("unreadable_review_time")
        )
    return values.select(
        *kept,
        row_status.alias("row_status"),
        F.when(row_status == "completed", reason).alias("reject_reason"),
        *LABEL_FIELDS,
        *([reviewed] if reviewed else []),
    )


def load_counts(normalized: DataFrame) -> DataFrame:
    """Completed, pending and skipped rows over all label files."""
    return normalized.agg(
        F.count_if(F.col("row_status") == "completed").alias("completed_count"),
        F.count_if(F.col("row_status") == "pending").alias("pending_count"),
        F.count_if(F.col("row_status") == "skipped").alias("skipped_count"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected_count"),
    )


def _distinct_spans(annotations: Column) -> Column:
    """Evidence spans in reviewer order, each comparison form kept once."""
    given = F.filter(annotations, lambda a: a["evidence_span"].isNotNull())
    forms = F.transform(given, lambda a: a["evidence_form"])
    first = F.filter(given, lambda a, i: F.array_position(forms, a["evidence_form"]) == i + 1)
    return F.transform(first, lambda a: a["evidence_span"])


def resolved_labels(
    tasks: DataFrame,
    annotations: DataFrame,
    expected: DataFrame | None = None,
    adjudications: DataFrame | None = None,
    *,
    task: str = "task_id",
) -> DataFrame:
    """Resolution status and final label of every task.

    ``annotations`` are completed rows (task, reviewer_id, label fields, reviewed_at),
    unique per (task, reviewer).  Precedence: adjudicated, awaiting_assigned_review,
    missing_annotation, single_review, reviewer_agreement, reviewer_core_agreement,
    needs_adjudication.  A merged label takes class, time and source of the first
    reviewer by id, all distinct evidence spans, the mean confidence and the latest
    review time.
    """
    entry = F.struct(
        "reviewer_id", "suspected_sepsis", "suspicion_time", "infection_source",
        "evidence_span", "confidence", "reviewed_at", "evidence_form",
    )
    compared = annotations.withColumns(
        {
            "_source_form": signature(F.col("infection_source")),
            "evidence_form": signature(F.col("evidence_span")),
        }
    )
    core = F.struct("suspected_sepsis", "suspicion_time", "_source_form")
    full = F.struct("suspected_sepsis", "suspicion_time", "_source_form", "evidence_form")
    merged = compared.groupBy(task).agg(
        F.array_sort(F.collect_list(entry)).alias("annotations"),
        F.size(F.collect_set(core)).alias("core_signatures"),
        F.size(F.collect_set(full)).alias("full_signatures"),
        F.avg("confidence").alias("_mean_confidence"),
        F.max("reviewed_at").alias("_latest_review"),
    )
    out = tasks.join(merged, task, "left")
    if expected is not None:
        out = out.join(expected, task, "left")
    else:
        out = out.withColumn("expected_reviewer_ids", F.lit(None).cast("array<string>"))
    if adjudications is not None:
        final = F.struct(
            F.col("adjudicator_id").alias("reviewer_id"), "suspected_sepsis", "suspicion_time",
            "infection_source", "evidence_span", "confidence",
            F.col("adjudicated_at").alias("reviewed_at"),
            F.lit(None).cast("string").alias("evidence_form"),
        )
        out = out.join(adjudications.select(task, final.alias("_final")), task, "left")
    else:
        out = out.withColumn("_final", F.element_at("annotations", 1)).withColumn(
            "_final", F.when(F.lit(False), F.col("_final"))
        )
    none = F.array().cast("array<string>")
    observed = F.coalesce(F.transform("annotations", lambda a: a["reviewer_id"]), none)
    wanted = F.coalesce("expected_reviewer_ids", none)
    out = computed_once(
        out.withColumn("reviewer_ids", observed)
        .withColumn("expected_reviewer_ids", wanted)
        .withColumn("_missing", F.array_except(wanted, observed))
        .withColumn("completed_annotation_count", F.size(observed))
    )
    done = F.col("completed_annotation_count")
    status = (
        F.when(F.col("_final").isNotNull(), F.lit("adjudicated"))
        .when(F.size("_missing") > 0, F.lit("awaiting_assigned_review"))
        .when(done == 0, F.lit("missing_annotation"))
        .when(done == 1, F.lit("single_review"))
        .when(F.col("full_signatures") == 1, F.lit("reviewer_agreement"))
        .when(F.col("core_signatures") == 1, F.lit("reviewer_core_agreement"))
        .otherwise(F.lit("needs_adjudication"))
    )
    spans = F.nullif(F.array_join(_distinct_spans(F.col("annotations")), " || "), F.lit(""))
    out = computed_once(
        out.withColumn("resolution_status", status).withColumn(
            "_spans", F.when(status.isin("reviewer_agreement", "reviewer_core_agreement"), spans)
        )
    )
    out = out.withColumn(
        "missing_expected_reviewers",
        F.when(F.col("resolution_status") == "adjudicated", none).otherwise(F.array_sort("_missing")),
    )
    adjudicated = F.col("resolution_status") == "adjudicated"
    single = F.col("resolution_status") == "single_review"
    agreed = F.col("resolution_status").isin("reviewer_agreement", "reviewer_core_agreement")
    settled = adjudicated | single | agreed
    first = F.when(adjudicated, F.col("_final")).otherwise(F.element_at("annotations", 1))

    def final_field(name: str) -> Column:
        return F.when(settled, first[name]).alias(name)

    return out.select(
        *tasks.columns,
        "resolution_status",
        "completed_annotation_count",
        "reviewer_ids",
        "expected_reviewer_ids",
        "missing_expected_reviewers",
        "core_signatures",
        "full_signatures",
        "annotations",
        settled.alias("is_final"),
        final_field("suspected_sepsis"),
        final_field("suspicion_time"),
        final_field("infection_source"),
        F.when(agreed, F.col("_spans")).when(settled, first["evidence_span"]).alias("evidence_span"),
        F.when(agreed, round6(F.col("_mean_confidence"))).when(settled, first["confidence"]).alias("confidence"),
        F.when(agreed, F.array_join("reviewer_ids", "|"))
        .when(settled, first["reviewer_id"])
        .alias("final_reviewer_id"),
        F.when(agreed, F.col("_latest_review")).when(settled, first["reviewed_at"]).alias("reviewed_at"),
        F.when(adjudicated, F.col("completed_annotation_count") + 1)
        .when(settled, F.col("completed_annotation_count"))
        .alias("source_annotation_count"),
        F.when(adjudicated, F.array_append("reviewer_ids", F.col("_final.reviewer_id")))
        .when(settled, F.col("reviewer_ids"))
        .alias("supporting_reviewer_ids"),
    )


def resolution_index(resolved: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Audit row per task with reviewer lists as joined text."""
    return resolved.select(
        *ids,
        "resolution_status",
        "completed_annotation_count",
        F.array_join("reviewer_ids", "|").alias("reviewer_ids"),
        F.array_join("expected_reviewer_ids", "|").alias("expected_reviewer_ids"),
        F.array_join("missing_expected_reviewers", "|").alias("missing_expected_reviewers"),
    )


def gold_labels(resolved: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Final label rows of the settled tasks."""
    return resolved.where("is_final").select(
        *ids,
        F.col("resolution_status").alias("review_resolution"),
        *LABEL_FIELDS,
        "final_reviewer_id",
        "reviewed_at",
        "source_annotation_count",
        "supporting_reviewer_ids",
    )


def label_summary(resolved: DataFrame) -> DataFrame:
    """Tasks per status, agreement rates of multiply reviewed tasks, blocking tasks."""
    status = F.col("resolution_status")
    statuses = (
        "single_review", "reviewer_agreement", "reviewer_core_agreement", "adjudicated",
        "needs_adjudication", "awaiting_assigned_review", "missing_annotation",
    )
    exact = F.count_if(status == "reviewer_agreement")
    core = F.count_if(status.isin("reviewer_agreement", "reviewer_core_agreement"))
    double = F.count_if(
        status.isin("reviewer_agreement", "reviewer_core_agreement", "needs_adjudication")
    )
    return resolved.agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count_if("is_final").alias("finalized_task_count"),
        F.count_if(~F.col("is_final")).alias("blocking_task_count"),
        *[F.count_if(status == s).alias(f"{s}_task_count") for s in statuses],
        double.alias("double_review_task_count"),
        round6(F.try_divide(exact, double)).alias("double_review_exact_agreement_rate"),
        round6(F.try_divide(core, double)).alias("double_review_core_agreement_rate"),
        F.sum(
            F.when(status == "awaiting_assigned_review", F.size("missing_expected_reviewers")).otherwise(0)
        ).alias("missing_assigned_review_count"),
    )


def adjudication_table(resolved: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Conflicting labels side by side: ``reviewer_1_*`` ... ``reviewer_k_*``, then blanks.

    ``k`` is the largest number of labels of any conflicting task; shorter rows are
    padded with blanks.
    """
    # a small share of the tasks, read twice: for the width and for the rows
    conflicts = cut_lineage(
        resolved.where(F.col("resolution_status") == "needs_adjudication").select(*ids, "annotations")
    )
    widest = conflicts.agg(F.max(F.size("annotations")).alias("k")).first()["k"] or 0
    fields = [
        ("id", "reviewer_id"), ("suspected_sepsis", "suspected_sepsis"),
        ("suspicion_time", "suspicion_time"), ("infection_source", "infection_source"),
        ("evidence_span", "evidence_span"), ("confidence", "confidence"), ("reviewed_at", "reviewed_at"),
    ]
    wide = [
        F.coalesce(F.get("annotations", F.lit(i))[source].cast("string"), F.lit("")).alias(
            f"reviewer_{i + 1}_{name}"
        )
        for i in range(widest)
        for name, source in fields
    ]
    blank = [
        F.lit("").alias(name)
        for name in (*[f"final_{f}" for f in LABEL_FIELDS], "adjudicator_id", "adjudicated_at", "adjudication_notes")
    ]
    return conflicts.select(*ids, *wide, *blank)
