"""The study's stages over raw clinical tables, each a lazy plan over typed frames.

``Tables`` maps a table name to its typed DataFrame.  Stages hand DataFrames on; what to
write at a stage boundary is up to the caller (``stayline.sources.sinks``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.functions.text import code_root, contains_any, first_label, included, lowered, matches
from stayline.functions.times import lenient_time
from stayline.functions.typing import blank_to_null, optional_column, typed
from stayline.operators import asof, checks as ck, cohort as co, datasets as ds, evaluate as ev
from stayline.operators import extraction as ex, labels as lb, notes as nt, rules, signals as sg
from stayline.operators.phrases import with_labels
from stayline.plans import fixed_values as fv
from stayline.session import configure, cut_lineage
from stayline.sources import sinks
from stayline.sources.tables import empty_table, text_table

Tables = dict[str, DataFrame]


# ------------------------------------------------------------------------------ sources


def raw_tables(spark: SparkSession, root: str, names=None) -> Tables:
    """Compressed CSV tables of the study, typed once."""
    configure(spark)
    out = {}
    for name in names or fv.RAW_FILES:
        raw = text_table(spark, f"{root}/{fv.RAW_FILES[name]}", fv.REQUIRED_COLUMNS[name])
        out[name] = typed(raw, fv.RAW_TYPES)
    return out


def _silver_name(folder: str, name: str) -> str:
    return f"silver_{hashlib.md5(folder.encode()).hexdigest()[:12]}_{name}"


def to_silver(tables: Tables, folder: str, *, buckets: int | None = None) -> None:
    """Convert once: a gzip file is one task, Parquet is splittable, typed and prunable.

    Event tables become bucketed tables (by default as many buckets as the session has
    shuffle partitions), so the stages join and aggregate them where they lie.  A table with
    a key too large for one bucket is clustered by key without buckets instead, which adaptive
    execution can split; other tables are plain.  The layout is kept beside the files.
    """
    layouts = []
    for name, df in tables.items():
        keys, order = fv.SILVER_LAYOUT.get(name, (("subject_id",), ()))
        keys = [k for k in keys if k in df.columns]
        n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if name in fv.SILVER_LAYOUT and keys and sinks.even_over(df, keys, n):
            sinks.to_buckets(df, _silver_name(folder, name), f"{folder}/{name}", keys, list(order), n)
            layouts.append((name, keys, [*keys, *order], n))
        elif keys:
            sinks.to_silver(df, f"{folder}/{name}", keys, list(order))
        else:
            sinks.write_parquet(df, f"{folder}/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        schema = "name string, keys array<string>, sort array<string>, buckets int"
        sinks.write_json(spark.createDataFrame(layouts, schema).coalesce(1), f"{folder}/layout")


def silver_tables(spark: SparkSession, folder: str, names=None) -> Tables:
    """The converted tables; bucketed ones are made known to the session's catalog first."""
    configure(spark)
    # a bucket key is part of the join key: the other side is dealt by that part, too
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    layouts = {r["name"]: r for r in spark.read.schema("name string, keys array<string>, sort array<string>, buckets int").json(f"{folder}/layout").collect()}
    out = {}
    for name in names or fv.RAW_FILES:
        files = spark.read.parquet(f"{folder}/{name}")
        if name in layouts:
            table, layout = _silver_name(folder, name), layouts[name]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
            quoted = {k: ", ".join(f"`{c}`" for c in layout[k]) for k in ("keys", "sort")}
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet LOCATION '{folder}/{name}' "
                f"CLUSTERED BY ({quoted['keys']}) SORTED BY ({quoted['sort']}) INTO {layout['buckets']} BUCKETS"
            )
            files = spark.table(table)
        out[name] = files
    return out


# ------------------------------------------------------------------------------- cohort


def _lab_items(tables: Tables, predicate) -> DataFrame:
    return sg.dictionary_items(tables["d_labitems"], predicate)


def _cultures(tables: Tables) -> DataFrame:
    return tables["microbiologyevents"].withColumn("time", F.coalesce("charttime", "chartdate"))


_IS_BLOOD_CULTURE = ("spec_type_desc", "test_name")


def _blood_culture():
    return contains_any([F.col(c) for c in _IS_BLOOD_CULTURE], fv.BLOOD_CULTURE_TEXT)


_EPISODE = ["subject_id", "hadm_id"]


def first_stays(tables: Tables) -> DataFrame:
    stays = tables["icustays"].select(
        "subject_id", "hadm_id", "stay_id",
        F.col("intime").alias("icu_intime"), F.col("outtime").alias("icu_outtime"),
    )
    return co.first_stay_cohort(
        stays, tables["admissions"], tables["patients"], min_age=fv.MIN_AGE,
        hours_before=fv.HOURS_BEFORE_STAY, hours_after=fv.HOURS_AFTER_STAY,
    )


def cohort_stage(tables: Tables, *, sample: int = fv.SAMPLE_SIZE) -> dict[str, DataFrame]:
    """Adult first stays, candidates with a signal, and the hash sample."""
    # joined to every event table below: computed once
    cohort = cut_lineage(first_stays(tables))
    orders = tables["prescriptions"].withColumn("time", F.coalesce("starttime", "stoptime"))
    antibiotic = sg.windowed_signals(
        cohort, orders, _EPISODE, "time",
        {
            "antibiotic": included(
                F.col("drug"), fv.ANTIBIOTIC_PATTERN, (F.col("drug"), fv.TOPICAL_DRUG_PATTERN),
                (F.col("route"), fv.NON_SYSTEMIC_ROUTE_PATTERN),
            )
        },
    )
    lactate_items = _lab_items(tables, lowered(F.col("label")) == fv.LACTATE_LABEL)
    lactate = sg.windowed_signals(
        cohort, sg.of_items(tables["labevents"], lactate_items), _EPISODE, "charttime",
        {"lactate": F.lit(True)},
    )
    culture = sg.windowed_signals(
        cohort, _cultures(tables), _EPISODE, "time", {"blood_culture": _blood_culture()}
    )
    flags = {
        "has_antibiotic_exposure": "antibiotic_event_count",
        "has_lactate_measurement": "lactate_event_count",
        "has_blood_culture": "blood_culture_event_count",
    }
    candidates = cut_lineage(
        co.with_any_signal(co.attach_signals(cohort, [antibiotic, lactate, culture], flags))
    )
    sampled = co.hash_sample(candidates, ["subject_id", "hadm_id", "stay_id"], sample)
    summary = co.cohort_summary(tables["icustays"], cohort, candidates, sampled, list(flags))
    return {"cohort": cohort, "candidates": candidates, "sampled": sampled, "summary": summary}


# -------------------------------------------------------------------------- rule labels


def _note_signal(cohort: DataFrame, notes: DataFrame | None) -> DataFrame:
    if notes is None:
        return empty_table(
            cohort.sparkSession,
            "stay_id bigint, first_note_evidence_time timestamp_ntz, first_note_evidence_id string, "
            "first_note_match_phrase string, first_note_source string, note_evidence_count bigint",
        )
    ck.require_columns(notes, ("stay_id", "note_charttime", "text"), "linked notes")
    read = with_labels(
        notes.select("stay_id", "note_charttime", optional_column(notes, "note_id").alias("note_id"), "text"),
        lowered(F.col("text")), labels={"phrase": fv.NOTE_PHRASES, "source": fv.CONTEXT_SOURCES},
    ).drop("text").where(F.col("phrase").isNotNull())
    return sg.windowed_signals(
        cohort, read, ["stay_id"], "note_charttime", {},
        [
            sg.FirstMatch(
                F.col("phrase").isNotNull(), ["note_id"],
                {
                    "first_note_evidence_id": "note_id",
                    "first_note_match_phrase": "phrase",
                    "first_note_source": "source",
                },
                "first_note_evidence_time", "note_evidence_count",
            )
        ],
    )


def _vital_signals(cohort: DataFrame, tables: Tables | None) -> DataFrame:
    names = ("fever", "hypotension", "tachycardia")
    if tables is None:
        columns = ", ".join(f"first_{n}_time timestamp_ntz, {n}_event_count bigint" for n in names)
        return empty_table(cohort.sparkSession, f"stay_id bigint, {columns}")
    label, value = lowered(F.col("label")), F.col("valuenum")
    kinds = tables["d_items"].select(
        "itemid",
        F.when(label.contains("temperature c"), "celsius")
        .when(label.contains("temperature f"), "fahrenheit").alias("temperature"),
        matches(label, fv.MEAN_PRESSURE_LABELS).alias("mean_pressure"),
        matches(label, fv.SYSTOLIC_PRESSURE_LABELS).alias("systolic_pressure"),
        (label == "heart rate").alias("heart_rate"),
    ).where("temperature IS NOT NULL OR mean_pressure OR systolic_pressure OR heart_rate")
    kind = (
        F.when((F.col("temperature") == "celsius") & (value >= fv.FEVER_CELSIUS), "fever")
        .when((F.col("temperature") == "fahrenheit") & (value >= fv.FEVER_FAHRENHEIT), "fever")
        .when(F.col("mean_pressure") & (value < fv.LOW_MEAN_PRESSURE), "hypotension")
        .when(F.col("systolic_pressure") & (value < fv.LOW_SYSTOLIC_PRESSURE), "hypotension")
        .when(F.col("heart_rate") & (value > fv.FAST_HEART_RATE), "tachycardia")
    )
    charted = (
        tables["chartevents"].where(value.isNotNull())
        .select("stay_id", "itemid", "charttime", "valuenum")
        .join(kinds, "itemid")
        .withColumn("support_type", kind)
    )
    return sg.windowed_signals(
        cohort, charted, ["stay_id"], "charttime", {n: F.col("support_type") == n for n in names}
    )


def rule_signals(
    cohort: DataFrame, tables: Tables, notes: DataFrame | None = None, *, include_vitals: bool = False
) -> DataFrame:
    """One row per stay with every rule signal; switched-off sources stay NULL."""
    admin = sg.windowed_signals(
        cohort, tables["emar"], _EPISODE, "charttime",
        {
            "antibiotic_admin": matches(lowered(F.col("event_txt")), fv.ADMINISTERED_PATTERN)
            & matches(lowered(F.col("medication")), fv.ANTIBIOTIC_PATTERN)
        },
    )
    cultures = _cultures(tables).withColumn(
        "source", first_label(lowered(F.col("spec_type_desc"), F.col("test_name")), fv.CONTEXT_SOURCES)
    )
    culture = sg.windowed_signals(
        cohort, cultures, _EPISODE, "time", {"blood_culture_order": _blood_culture()},
        [
            sg.FirstMatch(
                F.col("source").isNotNull(), list(_IS_BLOOD_CULTURE),
                {
                    "first_culture_context_source": "source",
                    "first_culture_context_specimen": "spec_type_desc",
                    "first_culture_context_test": "test_name",
                },
                "first_culture_context_time", "culture_context_event_count",
            )
        ],
    )
    label = lowered(F.col("label"))
    lab_kinds = tables["d_labitems"].select(
        "itemid",
        (label == fv.LACTATE_LABEL).alias("is_lactate"),
        matches(label, fv.WBC_LABEL_PATTERN).alias("is_wbc"),
    ).where("is_lactate OR is_wbc").distinct()
    value = F.col("valuenum")
    labs = sg.windowed_signals(
        cohort, tables["labevents"].join(lab_kinds, "itemid"), _EPISODE, "charttime",
        {
            "lactate": F.col("is_lactate"),
            "abnormal_wbc": F.col("is_wbc") & ((value < fv.WBC_LOW) | (value > fv.WBC_HIGH)),
        },
    )
    titled = (
        tables["diagnoses_icd"].select(*_EPISODE, "seq_num", "icd_code", "icd_version")
        .join(
            tables["d_icd_diagnoses"].select(
                "icd_code", "icd_version", F.col("long_title").alias("title"),
                first_label(lowered(F.col("long_title")), fv.DIAGNOSIS_SOURCES).alias("source"),
            ).where(F.col("source").isNotNull()),
            ["icd_code", "icd_version"],
        )
        .join(cohort.select(*_EPISODE, "stay_id"), _EPISODE)
    )
    diagnosis = sg.first_match(
        titled, ["seq_num", "title"],
        {"first_diagnosis_source": "source", "first_diagnosis_title": "title"},
        count_name="diagnosis_match_count",
    )
    vitals = _vital_signals(cohort, tables if include_vitals else None)
    base = cohort.select(
        "subject_id", F.col("subject_id").alias("patient_id"), "hadm_id", "stay_id",
        F.col("stay_id").alias("icustay_id"),
    )
    return co.attach_signals(
        base, [_note_signal(cohort, notes), admin, culture, labs, vitals, diagnosis]
    )


def rule_stage(
    cohort: DataFrame, tables: Tables, notes: DataFrame | None = None, *,
    include_vitals: bool = False, high_confidence_hours: float = fv.HIGH_CONFIDENCE_HOURS,
) -> dict[str, DataFrame]:
    """Rule labels in the fixed column order, with run counts."""
    ck.require_columns(
        cohort, ("subject_id", "hadm_id", "stay_id", "study_window_start", "study_window_end"), "cohort"
    )
    labels = rules.tiered_label(
        rule_signals(cohort, tables, notes, include_vitals=include_vitals),
        tier1=fv.TIER1, tier2=fv.TIER2, tier3=fv.TIER3,
        sources=fv.SOURCE_PRECEDENCE, evidence=fv.EVIDENCE, high_confidence_hours=high_confidence_hours,
    ).select(*fv.RULE_COLUMNS)
    triggers = [n for n, _ in (fv.TIER1, *fv.TIER2, *fv.TIER3)]
    return {
        "labels": labels,
        "summary": rules.rule_summary(labels, triggers),
        "categories": rules.category_counts(
            labels, ["suspicion_time_rule_source", "rule_confidence", "infection_source_rule"]
        ),
        "checks": ck.all_checks(
            [
                ck.rule_traceability(labels, [c for _, c in (fv.TIER1, *fv.TIER2)]),
                ck.coverage(cohort, labels, "rule_coverage", "stay_id"),
                ck.duplicate_keys(labels, "duplicate_stay", ["stay_id"]),
            ]
        ),
    }


# -------------------------------------------------------------------------------- notes


def note_stage(cohorts: dict[str, DataFrame], notes: Tables, folder: str | None = None) -> dict[str, DataFrame]:
    """Linked notes per domain for candidates and sample, with counts and the policy table.

    With a ``folder`` the sampled notes of each domain are written there, and the policy
    table holds their paths; without one the paths are unknown and nothing is approved by path.
    """
    out: dict[str, DataFrame] = {}
    counted: dict[str, DataFrame | None] = {}
    spark = cohorts["sampled"].sparkSession
    policies = []
    for domain, windowed, usage, gold, extraction in fv.NOTE_DOMAINS:
        source = notes.get(domain)
        usable = source is not None and set(fv.NOTE_REQUIRED) <= set(source.columns)
        if usable:
            full = source.select(
                *fv.NOTE_REQUIRED,
                optional_column(source, "note_id").alias("note_id"),
                optional_column(source, "storetime", "timestamp_ntz").alias("storetime"),
            )
            linked = nt.linked_notes(cohorts["candidates"], full, windowed=windowed)
            out[f"{domain}_candidates"] = linked
            out[domain] = nt.with_cohort_columns(cohorts["sampled"], linked)
            path = None
            if folder is not None:
                path = f"{folder.rstrip('/')}/{domain}"
                sinks.write_parquet(out[domain], path)
                out[domain] = spark.read.schema(out[domain].schema).parquet(path)
            reason = None if gold else f"usage policy {usage}"
            policies.append((domain, path, usage, gold, extraction, reason))
        counted[f"{domain}_candidates"] = out.get(f"{domain}_candidates")
        counted[f"{domain}_sampled"] = out.get(domain)
    out["policies"] = spark.createDataFrame(
        policies,
        "domain string, parquet_path string, usage_policy string, "
        "allowed_for_gold_annotations boolean, allowed_for_primary_extraction boolean, reason string",
    )
    if any(df is not None for df in counted.values()):
        out["counts"] = ck.table_counts(counted, {name: "stay_id" for name in counted})
    return out


def bundle_stage(
    linked: DataFrame, *, max_notes: int = fv.MAX_NOTES_PER_STAY, max_chars: int = fv.MAX_CHARS_PER_STAY
) -> DataFrame:
    """Annotation tasks: budgeted, ordered notes per stay."""
    ck.require_columns(linked, ("stay_id", *_EPISODE, "note_charttime", "note_id", "text"), "linked notes")
    return nt.note_bundles(nt.budgeted_notes(linked, max_notes=max_notes, max_chars=max_chars))


def prompt_stage(tasks: DataFrame) -> DataFrame:
    """System and user prompt of every task."""
    fields = {c: F.col(c) for c in ("task_id", "subject_id", "hadm_id", "stay_id")}
    fields["note_count"] = F.size("notes")
    fields["rendered_notes"] = nt.rendered_notes(F.col("notes"))
    return tasks.select(
        "task_id", "subject_id", "hadm_id", "stay_id",
        F.lit(fv.PROMPT_VERSION).alias("prompt_version"),
        F.lit(fv.SYSTEM_PROMPT).alias("system_prompt"),
        nt.prompt_column(fv.USER_PROMPT, fields).alias("user_prompt"),
    )


def extraction_stage(answers: DataFrame) -> dict[str, DataFrame]:
    """Validated extractions of raw model answers, with the run summary per model."""
    parsed = ex.parsed_answers(answers)
    return {"extractions": parsed, "summary": ex.extraction_summary(parsed)}


# ------------------------------------------------------------------------------- labels


TASK_IDS = ("task_id", "subject_id", "hadm_id", "stay_id", "note_count")


def label_stage(
    tasks: DataFrame, reviews: DataFrame, assignments: DataFrame | None = None, adjudications: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Gold labels, audit index, conflicts and summary; bad label rows stop the run."""
    normalized = lb.normalized_annotations(reviews)
    done = normalized.where(F.col("row_status") == "completed")
    final = None
    found = [
        ck.rejected_annotations(normalized),
        ck.duplicate_keys(tasks, "duplicate_task", ["task_id"]),
        ck.duplicate_keys(done, "duplicate_annotation", ["task_id", "reviewer_id"]),
        ck.unknown_keys(reviews, tasks, "unknown_task", "task_id"),
        ck.count_where(reviews, "missing_reviewer", blank_to_null(F.col("reviewer_id")).isNull()),
    ]
    if adjudications is not None:
        judged = lb.normalized_annotations(
            adjudications, prefix="final_", status=None, reviewed="adjudicated_at"
        )
        final = judged.where(F.col("row_status") == "completed")
        found += [
            ck.rejected_annotations(judged),
            ck.duplicate_keys(final, "duplicate_adjudication", ["task_id"]),
            ck.unknown_keys(adjudications, tasks, "unknown_adjudicated_task", "task_id"),
            ck.count_where(adjudications, "missing_adjudicator", blank_to_null(F.col("adjudicator_id")).isNull()),
        ]
    ck.enforce(*found)
    expected = lb.expected_reviewers(assignments) if assignments is not None else None
    resolved = lb.resolved_labels(tasks.select(*TASK_IDS, "first_note_time", "last_note_time"), done, expected, final)
    ids = [*TASK_IDS, "first_note_time", "last_note_time"]
    return {
        "resolved": resolved,
        "gold": lb.gold_labels(resolved, ids),
        "index": lb.resolution_index(resolved, list(TASK_IDS)),
        "conflicts": lb.adjudication_table(resolved, ids),
        "summary": lb.label_summary(resolved),
        "load_counts": lb.load_counts(normalized),
    }


# ----------------------------------------------------------------- predictors, datasets


def predictor_stage(gold: DataFrame, rule_labels: DataFrame, extractions: DataFrame, models: dict[str, str]) -> DataFrame:
    """Gold, rule and model predictions in one long relation.

    ``models`` maps a model slot to its id; times in label artifacts are text.
    """
    gold_rows = gold.select(
        "task_id", "suspected_sepsis", lenient_time(F.col("suspicion_time")).alias("suspicion_time"),
        blank_to_null(F.col("infection_source")).alias("infection_source"),
        blank_to_null(F.col("evidence_span")).alias("evidence_span"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    parts = [
        ev.as_predictor(gold_rows, "gold", "gold", "gold_labels"),
        ev.as_predictor(ev.rule_predictions(rule_labels, gold), "x_rule", "rule_based", "rule_based_baseline"),
    ]
    for slot, model_id in models.items():
        said = extractions.where(F.col("model_slot") == slot)
        fields = said.select(
            "task_id", "extraction_status",
            F.col("normalized_extraction.suspected_sepsis").alias("suspected_sepsis"),
            lenient_time(F.col("normalized_extraction.suspicion_time")).alias("suspicion_time"),
            *[
                F.col(f"normalized_extraction.{f}").alias(f)
                for f in ("infection_source", "evidence_span", "confidence")
            ],
        )
        parts.append(ev.as_predictor(fields, slot, "model", model_id, status=F.col("extraction_status")))
    return ev.stacked(parts)


def evaluation_stage(gold: DataFrame, predictions: DataFrame, panel: list[str]) -> dict[str, DataFrame]:
    """Metrics per predictor and disagreement per pair; gold is not its own predictor."""
    truth = gold.withColumn("suspicion_time", lenient_time(F.col("suspicion_time")))
    others = predictions.where(F.col("predictor_name") != "gold")
    return {
        "metrics": ev.evaluate_predictors(truth, others),
        "pairwise": ev.pairwise_disagreement(others, panel),
    }


def stay_details(cohort: DataFrame, tables: Tables) -> DataFrame:
    """Cohort stays with optional demographics and the earlier of the two death times."""
    patients, admissions = tables["patients"], tables["admissions"]
    people = patients.select(
        "subject_id",
        blank_to_null(optional_column(patients, "gender")).alias("gender"),
        optional_column(patients, "dod", "timestamp_ntz").alias("_dod"),
    )
    visits = admissions.select(
        "subject_id", "hadm_id",
        *[blank_to_null(optional_column(admissions, c)).alias(c) for c in ("admission_type", "insurance", "marital_status")],
        blank_to_null(optional_column(admissions, ("race", "ethnicity"))).alias("race"),
        optional_column(admissions, "deathtime", "timestamp_ntz").alias("_deathtime"),
    )
    return (
        cohort.join(people, "subject_id")
        .join(visits, _EPISODE)
        .withColumn("death_time", F.least("_deathtime", "_dod"))
        .drop("_deathtime", "_dod")
    )


def dataset_stage(
    predictions: DataFrame, gold: DataFrame, cohort: DataFrame, tables: Tables, *,
    window_hours: float = fv.EARLY_TREATMENT_HOURS,
) -> dict[str, DataFrame]:
    """Analysis datasets of all predictors; violations of the label contract stop the run."""
    stays = stay_details(cohort, tables)
    tasks = gold.select("task_id", "subject_id", "hadm_id", "stay_id")
    windows = tasks.join(stays.select("stay_id", "study_window_start", "study_window_end"), "stay_id")
    placed = predictions.join(windows.drop("subject_id", "hadm_id", "stay_id"), "task_id")
    per_predictor = tasks.select("task_id").withColumn("_wanted", F.lit(1)).join(
        predictions.groupBy("task_id").agg(F.count_distinct("predictor_name").alias("_have")), "task_id", "left"
    )
    panel_size = predictions.select("predictor_name").distinct().count()
    ck.enforce(
        ck.duplicate_keys(tasks, "duplicate_task", ["task_id"]),
        ck.duplicate_keys(tasks, "duplicate_gold_stay", ["stay_id"]),
        ck.duplicate_keys(predictions, "duplicate_prediction", ["task_id", "predictor_name"]),
        ck.unknown_keys(predictions, tasks, "prediction_of_unknown_task", "task_id"),
        ck.count_where(
            per_predictor, "task_without_all_predictors", F.coalesce("_have", F.lit(0)) != panel_size
        ),
        ck.unknown_keys(tasks, stays, "task_without_stay", "stay_id"),
        ck.identity_mismatch(tasks, stays, "identity_mismatch", "stay_id", _EPISODE),
        ck.invalid_predictions(predictions),
        ck.positive_without_time(predictions),
        ck.time_zero_outside_window(placed.where("suspected_sepsis")),
    )
    rows = ds.analysis_datasets(predictions, gold, stays, window_hours=window_hours)
    return {"datasets": rows, "summary": ds.dataset_summary(rows)}


def perturbation_stage(
    datasets: DataFrame, predictors=("gold",), shifts=fv.SHIFT_HOURS, *,
    window_hours: float = fv.EARLY_TREATMENT_HOURS,
) -> dict[str, DataFrame]:
    """Shifted copies of the chosen predictors' datasets."""
    chosen = ds.selected_predictors(datasets, list(predictors))
    shifted = ds.shift_time_zero(chosen, shifts, window_hours=window_hours)
    return {"shifted": shifted, "summary": ds.shift_summary(shifted)}


# --------------------------------------------------------------------------- covariates


def _measure_columns(spec: dict, convert=None) -> dict:
    out = {}
    for name, (items, low, high) in spec.items():
        value = F.col("valuenum")
        if convert and set(convert) & set(items):
            value = F.when(
                F.col("itemid").isin(*map(int, convert)), (F.col("valuenum") - 32.0) * (5.0 / 9.0)
            ).otherwise(F.col("valuenum"))
        out[name] = (F.col("itemid").isin(*map(int, items)) & value.between(low, high), value)
    return out


def _items(events: DataFrame, items) -> DataFrame:
    """Item filter on the bare column: skips row groups of files sorted by item."""
    return events.where(F.col("itemid").isin(*map(int, items)))


def covariates(rows: DataFrame, tables: Tables) -> DataFrame:
    """The 16 covariates known before time zero, next to the analysis rows.

    ``rows`` may hold many datasets (predictors, shifts): distinct lookups are shared, so
    each event table is read and joined once for all of them.
    """
    rows = rows.withColumn("time_zero", F.col("suspicion_time"))
    # the analysed stays are few beside all events: each event table is reduced to them first
    stays, episodes = asof.key_table(rows, ["stay_id"]), asof.key_table(rows, _EPISODE)

    def of_stays(events: DataFrame) -> DataFrame:
        return asof.reduce_to_keys(events, stays, ["stay_id"])

    def of_episodes(events: DataFrame) -> DataFrame:
        return asof.reduce_to_keys(events, episodes, _EPISODE)

    chart_items = [i for items, _, _ in fv.CHART_MEASURES.values() for i in items]
    charts = asof.latest_before(
        rows, of_stays(_items(tables["chartevents"], [*chart_items, *fv.VENTILATION_CHART_ITEMS])), ["stay_id"], "charttime", order=["storetime"],
        values=_measure_columns(fv.CHART_MEASURES, fv.FAHRENHEIT_ITEMS),
        flags={"_ventilated": F.col("itemid").isin(*map(int, fv.VENTILATION_CHART_ITEMS))},
    )
    labs = asof.latest_before(
        rows, of_episodes(_items(tables["labevents"], [i for items, _, _ in fv.LAB_MEASURES.values() for i in items])),
        _EPISODE, "charttime", order=["storetime"],
        values=_measure_columns(fv.LAB_MEASURES),
    )
    procedures = tables["procedureevents"].join(
        tables["d_items"]
        .where(blank_to_null(F.col("label")).isin(*fv.VENTILATION_PROCEDURES))
        .select("itemid").distinct(),
        "itemid", "left_semi",
    )
    operated = asof.latest_before(
        rows, of_stays(procedures), ["stay_id"], "starttime", flags={"_operated": F.lit(True)}
    )
    infused = asof.latest_before(
        rows, of_stays(_items(tables["inputevents"], fv.VASOPRESSOR_ITEMS)), ["stay_id"], "starttime",
        flags={"pre_t0_vasopressor": F.lit(True)},
    )
    unit = blank_to_null(F.col("careunit"))
    units = asof.latest_before(
        rows, of_episodes(tables["transfers"]), _EPISODE, "intime", start=None, order=["transfer_id"],
        values={"pre_t0_careunit": (unit.isNotNull(), unit)},
    )
    admissions = tables["admissions"].select("subject_id", "hadm_id", "admittime")
    coded = tables["diagnoses_icd"].select(*_EPISODE, code_root(F.col("icd_code")).alias("root")).join(
        admissions, _EPISODE
    )
    counts = ("prior_admission_count", "prior_diagnosis_root_count")
    history = asof.prior_distinct_counts(
        rows, {counts[0]: (admissions, "hadm_id", "admittime"), counts[1]: (coded, "root", "admittime")},
        "subject_id", "admittime",
    )
    out = asof.attach_latest(rows, charts, ["stay_id"], flags=["_ventilated"])
    out = asof.attach_latest(out, labs, _EPISODE)
    out = asof.attach_latest(out, operated, ["stay_id"], flags=["_operated"])
    out = asof.attach_latest(out, infused, ["stay_id"], flags=["pre_t0_vasopressor"])
    out = asof.attach_latest(out, units, _EPISODE, start=None)
    out = asof.attach_counts(out, history, "subject_id", "admittime", counts)
    return out.withColumns(
        {
            "age_years": F.col("anchor_age").cast("double"),
            "sex": blank_to_null(F.col("gender")),
            "admission_type": blank_to_null(F.col("admission_type")),
            "calendar_year": F.year("time_zero"),
            "calendar_month": F.month("time_zero"),
            "pre_t0_mechanical_ventilation": F.col("_ventilated") | F.col("_operated"),
        }
    ).drop("_ventilated", "_operated")
