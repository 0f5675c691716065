"""Linked notes, budgeted note bundles and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from stayline.functions.typing import strip
from stayline.operators.signals import in_window


def linked_notes(
    cohort: DataFrame, notes: DataFrame, *, windowed: bool, keys: tuple[str, ...] = ("subject_id", "hadm_id")
) -> DataFrame:
    """Notes of the cohort's stays; ``windowed`` keeps those charted inside the window."""
    renamed = notes.select(
        *keys,
        "note_id",
        F.col("charttime").alias("note_charttime"),
        F.col("storetime").alias("note_storetime"),
        "text",
    )
    if windowed:
        return in_window(cohort, renamed, keys, "note_charttime")
    return renamed.join(cohort.select(*keys, "stay_id"), list(keys))


def with_cohort_columns(sampled: DataFrame, linked: DataFrame) -> DataFrame:
    """Linked notes of the sampled stays next to all cohort columns."""
    return sampled.join(
        linked.select("stay_id", "note_id", "note_charttime", "note_storetime", "text"), "stay_id"
    )


def approved_domain(policies: DataFrame, *, purpose: str = "allowed_for_gold_annotations") -> str:
    """The single note domain approved for a purpose; anything else is an error.

    The policy table has one row per note domain and is read with a limit of two rows.
    """
    approved = policies.where(F.col(purpose) & F.col("parquet_path").isNotNull()).limit(2).collect()
    if not approved:
        raise ValueError("no note domain is approved for this use")
    if len(approved) > 1:
        raise ValueError("several note domains are approved; choose one explicitly")
    return approved[0]["domain"]


def _resolved(path: Column) -> Column:
    """One spelling of a path: no scheme of the local file system, no '.', no spare slashes."""
    plain = F.regexp_replace(F.regexp_replace(strip(path), r"^file:/+", "/"), r"(/\.)+(?=/|$)", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?<!:)/{2,}", "/"), r"(?<=.)/$", "")


def choose_notes(
    policies: DataFrame | None, path: str | None = None, *, allow_nonprimary: bool = False
) -> tuple[str, str]:
    """Note path to use and how it was chosen, under the domain policy.

    Without a path the single approved domain is used.  An explicit path that belongs to
    an unapproved domain needs ``allow_nonprimary``.
    """
    if path is None:
        if policies is None:
            raise FileNotFoundError("neither a note path nor a domain policy was given")
        domain = approved_domain(policies)
        row = policies.where(F.col("domain") == domain).select("parquet_path").first()
        return row["parquet_path"], "manifest_approved"
    known = None
    if policies is not None:
        known = policies.where(_resolved(F.col("parquet_path")) == _resolved(F.lit(path))).first()
    if known is None:
        return path, "explicit_path"
    if known["allowed_for_gold_annotations"]:
        return path, "explicit_manifest_match"
    if not allow_nonprimary:
        raise ValueError(f"note domain {known['domain']!r} is not approved: {known['reason']}")
    return path, "explicit_nonprimary_override"


def budgeted_notes(
    notes: DataFrame,
    *,
    max_notes: int = 20,
    max_chars: int = 40_000,
    stay: str = "stay_id",
    time: str = "note_charttime",
    note: str = "note_id",
    text: str = "text",
) -> DataFrame:
    """Earliest notes per stay within a note and a running character budget.

    The character sum runs over all earlier notes, so one note over the budget also ends
    the bundle.  Both columns share one expanding window, which lets the rank bound move
    below the shuffle: each map task sends at most ``max_notes`` rows per stay.
    """
    # the text closes the order, so notes without time and id still have a fixed one
    order = Window.partitionBy(stay).orderBy(
        F.col(time).asc_nulls_last(), F.col(note).asc_nulls_last(), F.col(text)
    )
    expanding = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        notes.where(F.col(stay).isNotNull() & F.col(text).isNotNull())
        .withColumns(
            {
                "note_char_count": F.length(text),
                "note_rank": F.row_number().over(order),
                "running_char_count": F.sum(F.length(text)).over(expanding),
            }
        )
        .where((F.col("note_rank") <= max_notes) & (F.col("running_char_count") <= max_chars))
    )


def note_bundles(
    budgeted: DataFrame,
    *,
    stay: str = "stay_id",
    ids: tuple[str, ...] = ("subject_id", "hadm_id"),
    time: str = "note_charttime",
) -> DataFrame:
    """One task per stay with its ordered notes; groups are bounded by the note budget."""
    note = F.struct(
        F.col(time).isNull().alias("no_time"),
        F.col(time).alias("at"),
        F.col("note_id").isNull().alias("no_id"),
        F.col("note_id").cast("string").alias("note_id"),
        F.col("text").alias("text"),
    )
    grouped = budgeted.groupBy(stay, *ids).agg(F.array_sort(F.collect_list(note)).alias("_notes"))
    notes = F.transform(
        "_notes",
        lambda n: F.struct(
            n["note_id"].alias("note_id"),
            n["at"].cast("string").alias("charttime"),
            n["text"].alias("text"),
        ),
    )
    empty = F.lit(None).cast("string")
    template = F.struct(
        F.lit(None).cast("boolean").alias("suspected_sepsis"),
        empty.alias("suspicion_time"),
        empty.alias("infection_source"),
        empty.alias("evidence_span"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return (
        grouped.withColumn("notes", notes)
        .select(
            F.concat(F.lit("stay-"), F.col(stay).cast("string")).alias("task_id"),
            *ids,
            stay,
            F.size("notes").alias("note_count"),
            F.element_at("notes", 1)["charttime"].alias("first_note_time"),
            F.element_at("notes", -1)["charttime"].alias("last_note_time"),
            "notes",
            template.alias("annotation_template"),
            F.lit("pending").alias("annotation_status"),
        )
    )


def rendered_notes(notes: Column) -> Column:
    """Numbered text blocks of a note list, with fallbacks for missing id and time."""

    def or_else(value: Column, fallback: Column) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), fallback)

    def block(n: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        return F.concat(
            F.lit("[Note "), number, F.lit("]\nnote_id: "),
            or_else(n["note_id"], F.concat(F.lit("note-"), number)),
            F.lit("\ncharttime: "),
            or_else(n["charttime"], F.lit("unknown")),
            F.lit("\ntext:\n"),
            strip(F.coalesce(n["text"], F.lit(""))),
        )

    return F.array_join(F.transform(notes, block), "\n\n")


def prompt_column(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a prompt template with columns."""
    text: Column = F.lit(template)
    for name, value in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text
