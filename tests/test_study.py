"""All stages on invented tables, from gzip CSV to the robustness summary."""

import json
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import clinic
from helpers import records
from stayline.operators import checks as ck, labels as lb, notes as nt
from stayline.plans import effects, fixed_values as fv, study
from stayline.sources import sinks, tables as src


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("clinic"))
    facts = clinic.make(root)
    raw = study.raw_tables(spark, root)
    study.to_silver(raw, f"{root}/silver")
    tables = study.silver_tables(spark, f"{root}/silver")
    cohorts = study.cohort_stage(tables, sample=150)
    sinks.write_parquet(cohorts["sampled"], f"{root}/sampled")
    cohorts["sampled"] = spark.read.parquet(f"{root}/sampled")
    return {"root": root, "facts": facts, "tables": tables, "cohorts": cohorts}


@pytest.fixture(scope="module")
def judged(spark, world):
    """Notes, tasks, reviews, gold labels, rule labels and model answers."""
    root, cohorts, facts = world["root"], world["cohorts"], world["facts"]
    from stayline.functions.typing import typed

    found = {r["file_key"]: r["path"] for r in src.discovered_files(spark, root, fv.NOTE_FILES).collect()}
    assert set(found) == {"radiology"}
    folders = [r["folder"] for r in src.discovered_folders(spark, root, "note").collect()]
    assert len(folders) == 1 and folders[0].endswith("/note")
    raw = typed(src.text_table(spark, found["radiology"], fv.NOTE_REQUIRED, multiline=True), fv.RAW_TYPES)
    noted = study.note_stage(cohorts, {"radiology": raw})
    with pytest.raises(ValueError):
        nt.choose_notes(noted["policies"])
    tasks = study.bundle_stage(noted["radiology"])
    sinks.write_json(tasks, f"{root}/tasks")
    tasks = src.task_bundles(spark, f"{root}/tasks")
    sinks.write_parquet(noted["radiology"], f"{root}/linked")
    linked = src.note_table(spark, f"{root}/linked", ("stay_id", "note_charttime", "text"))
    rules = study.rule_stage(cohorts["sampled"], world["tables"], linked, include_vitals=True)
    ck.enforce(rules["checks"])
    sinks.write_parquet(rules["labels"], f"{root}/rules")
    labels = spark.read.parquet(f"{root}/rules")
    assignments = lb.assign_reviewers(tasks, ["dr a", "dr b"], fraction=0.3, seed="1")
    times = spark.createDataFrame(
        [(s, str(f["note"]), str(f["culture"])) for s, f in facts.items()], "stay_id bigint, note string, culture string")
    reviews = assignments.join(tasks.select("task_id", "stay_id"), "task_id").join(times, "stay_id").select(
        "task_id", "reviewer_id", F.lit("pending").alias("annotation_status"), F.lit("yes").alias("suspected_sepsis"),
        F.col("culture").alias("suspicion_time"), F.lit("Lung ").alias("infection_source"),
        F.concat(F.lit("seen by "), "reviewer_id").alias("evidence_span"), F.lit("0.9").alias("confidence"),
        F.lit("").alias("reviewed_at"))
    sinks.write_per_key(reviews, "reviewer_id", f"{root}/reviews", kind="csv")
    packets = [f"{root}/reviews/reviewer_id_folder=dr_a", f"{root}/reviews/reviewer_id_folder=dr_b"]
    reviews = src.label_files(spark, packets, ("task_id", "reviewer_id"))
    assert reviews.select("source_path").distinct().count() >= 2
    resolved = study.label_stage(tasks, reviews, assignments)
    gold = resolved["gold"]
    sinks.write_csv(gold, f"{root}/gold", order=["task_id"])
    gold = typed(src.text_table(spark, f"{root}/gold"), {k: "bigint" for k in ("subject_id", "hadm_id", "stay_id")})
    from stayline.functions.typing import lenient_bool

    gold = gold.withColumn("suspected_sepsis", lenient_bool(F.col("suspected_sepsis")))
    answers = []
    rows = {r["task_id"]: r for r in tasks.select("task_id", "stay_id", "subject_id", "hadm_id").collect()}
    for slot, lag in (("model_1", 20), ("model_2", 90)):
        for i, (task, r) in enumerate(sorted(rows.items())):
            at = facts[r["stay_id"]]["culture"] - timedelta(minutes=lag if i % 2 else 5)
            body = {"suspected_sepsis": True, "suspicion_time": str(at), "infection_source": "lung", "evidence_span": "x", "confidence": 0.5}
            answers.append((task, r["subject_id"], r["hadm_id"], r["stay_id"], slot, slot + "_id", 1.0, "ok: " + json.dumps(body)))
    said = spark.createDataFrame(answers, "task_id string, subject_id bigint, hadm_id bigint, stay_id bigint, model_slot string, model_id string, latency_seconds double, raw_response_text string")
    extracted = study.extraction_stage(said)
    return {"tasks": tasks, "noted": noted, "rules": rules, "labels": labels, "resolved": resolved, "gold": gold,
            "extracted": extracted, "prompts": study.prompt_stage(tasks)}


@pytest.fixture(scope="module")
def analysed(spark, world, judged):
    models = {"model_1": "model_1_id", "model_2": "model_2_id"}
    rule = judged["labels"].withColumn(
        "suspicion_time_rule", F.coalesce("first_blood_culture_order_time", "suspicion_time_rule"))
    predictions = study.predictor_stage(judged["gold"], rule, judged["extracted"]["extractions"], models)
    built = study.dataset_stage(predictions, judged["gold"], world["cohorts"]["sampled"], world["tables"])
    sinks.write_parquet(built["datasets"], f"{world['root']}/datasets")
    datasets = spark.read.parquet(f"{world['root']}/datasets")
    return {"predictions": predictions, "datasets": datasets, "summary": built["summary"]}


def test_cohort(world):
    got = {r["stay_id"]: r for r in records(world["cohorts"]["candidates"])}
    facts = {s: f for s, f in world["facts"].items() if f["age"] >= 18}
    assert set(got) == set(facts)  # a later stay of the same subject never counts
    assert all(r["antibiotic_event_count"] == 1 and r["first_antibiotic_time"] == facts[s]["drug"] for s, r in got.items())
    assert all(r["lactate_event_count"] == 2 and r["blood_culture_event_count"] == 1 for r in got.values())
    summary = {r["measure"]: r["rows"] for r in records(world["cohorts"]["summary"])}
    assert summary["candidate_cohort"] == len(facts) and summary["sampled_cohort"] == 150
    assert summary["total_stays"] == 240 + 48


def test_rule_labels(world, judged):
    got = records(judged["labels"])
    assert len(got) == 150
    for r in got:
        f = world["facts"][r["stay_id"]]
        wrote = (r["stay_id"] - 5000) % 4
        assert (r["first_note_match_phrase"] == "concern for infection") == bool(wrote)
        if wrote:
            assert r["suspicion_time_rule"] == f["note"] and r["infection_source_rule"] == "pulmonary"
            gap = min(abs((f["note"] - t).total_seconds()) for t in (r["first_antibiotic_admin_time"], r["first_blood_culture_order_time"]))
            assert r["rule_confidence"] == ("high" if gap <= 6 * 3600 else "medium")
        else:
            assert r["suspicion_time_rule"] == min(r["first_antibiotic_admin_time"], r["first_blood_culture_order_time"])
            assert r["infection_source_rule"] == "urinary" and r["infection_source_rule_source"] == "culture_context"
        assert r["first_culture_context_specimen"] == "URINE"
    assert judged["rules"]["summary"].first()["tier3_lactate_count"] == 150
    assert tuple(judged["labels"].columns) == fv.RULE_COLUMNS
    some = [r for r in got if r["first_fever_time"] is not None]
    assert some and len(some) < 150


def test_rule_stage_without_notes_and_vitals(world):
    labels = study.rule_stage(world["cohorts"]["sampled"], world["tables"])["labels"]
    row = labels.first()
    assert row["first_note_evidence_time"] is None and row["first_fever_time"] is None
    assert row["rule_confidence"] == "medium"


def test_notes_and_prompts(judged):
    assert judged["tasks"].count() == 150
    counts = {r["table_name"]: r["distinct_keys"] for r in records(judged["noted"]["counts"])}
    assert counts["radiology_sampled"] == 150 and counts["discharge_sampled"] == 0
    prompt = judged["prompts"].first()
    assert prompt["user_prompt"].startswith("Extract the following") and "- note_count: 1\n" in prompt["user_prompt"]
    assert "[Note 1]\nnote_id: n" in prompt["user_prompt"] and "{rendered_notes}" not in prompt["user_prompt"]
    assert '"suspected_sepsis": true or false' in prompt["user_prompt"]


def test_consensus(judged):
    summary = judged["resolved"]["summary"].first()
    assert summary["task_count"] == summary["finalized_task_count"] == 150
    assert summary["reviewer_core_agreement_task_count"] == 45
    assert summary["double_review_core_agreement_rate"] == 1.0 and summary["double_review_exact_agreement_rate"] == 0.0


def test_label_stage_stops_on_bad_rows(spark, judged):
    bad = spark.createDataFrame(
        [("stay-0", "r", "completed", "yes", "", "", "", "2", "")],
        "task_id string, reviewer_id string, annotation_status string, suspected_sepsis string, suspicion_time string, "
        "infection_source string, evidence_span string, confidence string, reviewed_at string")
    with pytest.raises(ck.ContractError, match="rejected_annotation=1, unknown_task=1"):
        study.label_stage(judged["tasks"], bad)


def test_datasets(world, analysed):
    rows = records(analysed["datasets"])
    assert len(rows) == 4 * 150
    from stayline.operators.datasets import DATASET_COLUMNS

    assert tuple(analysed["datasets"].columns) == DATASET_COLUMNS
    for r in rows:
        f = world["facts"][r["stay_id"]]
        if r["predictor_name"] == "gold":
            assert r["suspicion_time"] == f["culture"]
            assert r["treatment_delay_hours"] == pytest.approx((f["drug"] - f["culture"]).total_seconds() / 3600, abs=1e-6)
        assert r["race"] == "X" and r["insurance"] is None
        if f["death"] and r["stay_id"] % 2:
            assert r["death_time"] == f["death"].replace(hour=0, minute=0, second=0)


def test_evaluation(judged, analysed):
    out = study.evaluation_stage(judged["gold"], analysed["predictions"], ["x_rule", "model_1", "model_2"])
    got = {r["predictor_name"]: r for r in records(out["metrics"])}
    assert set(got) == {"x_rule", "model_1", "model_2"}
    assert got["model_1"]["precision"] == 1.0 and got["model_1"]["infection_source_agreement_rate"] == 1.0
    assert got["model_2"]["within_1h_rate"] == 0.5
    assert len(records(out["pairwise"])) == 3


def test_covariates(world, analysed):
    rows = records(study.covariates(analysed["datasets"], world["tables"]))
    assert len(rows) == 600
    for r in rows:
        s = r["stay_id"] - 5000
        assert 70 <= r["pre_t0_heart_rate"] <= 130 and 36 < r["pre_t0_temperature_c"] < 39
        assert r["prior_admission_count"] == (1 if s % 5 == 0 else 0)
        assert r["prior_diagnosis_root_count"] == (2 if s % 5 == 0 else 0)
        assert r["pre_t0_careunit"] in ("MICU", "SICU")
        assert r["pre_t0_mechanical_ventilation"] == r["pre_t0_vasopressor"] == (r["pre_t0_heart_rate"] > 112)


def test_causal_stage(spark, world, analysed):
    datasets = analysed["datasets"]
    shifted = study.perturbation_stage(datasets, shifts=(-1.0, 0.5))
    assert {r["shift_hours"] for r in records(shifted["summary"])} == {-1.0, 0.5}
    out = effects.causal_stage(datasets, world["tables"], shifted["shifted"])
    summary = {(r["dataset_name"], r["analysis_scope"]): r for r in records(out["summary"])}
    assert tuple(out["summary"].columns) == fv.SUMMARY_COLUMNS
    assert len(summary) == 4 + 4 + 2
    gold = summary["gold", "full_cohort"]
    assert gold["convergence_status"] == "ok" and gold["primary_ci_lower"] < gold["primary_hr"] < gold["primary_ci_upper"]
    assert gold["treated_count"] + gold["control_count"] == gold["analysis_row_count"] <= 150
    assert summary["gold", "disagreement_subset"]["input_row_count"] == 75
    assert summary["synthetic_gold_minus1h", "full_cohort"]["source_predictor_name"] == "gold"
    detail = out["detail"]
    assert tuple(detail.columns) == fv.DETAIL_COLUMNS
    assert detail.count() == sum(r["analysis_row_count"] for r in summary.values())
    arms = {r["treatment_group"] for r in out["curves"].select("treatment_group").distinct().collect()}
    assert arms == {"control", "treated"}
    assert {r["dataset_name"] for r in out["bias"].collect()} == {"x_rule", "model_1", "model_2"}
    assert out["stability"].first()["model_count"] == 2
    assert [r["shift_hours"] for r in out["trend"].collect()] == [-1.0, 0.5]


def test_files_round_trip(spark, world, analysed):
    path = f"{world['root']}/analysis_csv"
    sinks.write_csv(analysed["datasets"], path)
    back = src.analysis_files(spark, path)
    assert back.columns == analysed["datasets"].columns
    a = records(analysed["datasets"].select("task_id", "predictor_name", "suspicion_time", "mortality_28d", "followup_duration_days"), "task_id", "predictor_name")
    b = records(back.select("task_id", "predictor_name", "suspicion_time", "mortality_28d", "followup_duration_days"), "task_id", "predictor_name")
    assert a == b
    with open(f"{world['root']}/manifest.json", "w") as file:
        json.dump({"predictor_summaries": [{"predictor_name": "gold", "csv_path": path}, {"predictor_name": "x", "csv_path": path}]}, file)
    specs = src.manifest_rows(spark, f"{world['root']}/manifest.json", "predictor_summaries")
    assert [r["predictor_name"] for r in records(specs)] == ["gold", "x"]
    with pytest.raises(ck.ContractError):
        src.manifest_rows(spark, f"{world['root']}/manifest.json", "assignments")


def between_scan_and_stay(df, table):
    """The plan nodes between the scan of a silver table and the first grouping by stay."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    out = []
    for at, line in enumerate(lines):
        if "FileScan" in line and f"_{table}[" in line.replace(f"_{table} [", f"_{table}["):
            own, level = [], depth[at]
            for above in range(at, -1, -1):
                if depth[above] < level or above == at:
                    level = depth[above]
                    own.append(lines[above])
                    if re.search(r"Aggregate\(keys?=\[stay_id", lines[above]) and "functions=[partial_" not in lines[above]:
                        break
            out.append(own)
    return out


def test_events_stay_where_they_lie(spark, world):
    """No exchange between an event scan and its signals, though the cohort is not broadcast."""
    tables, cohorts = world["tables"], world["cohorts"]
    merged = cohorts["cohort"].hint("merge")
    rules = study.rule_signals(merged, tables, include_vitals=True)
    for name in ("labevents", "microbiologyevents", "emar", "chartevents"):
        paths = between_scan_and_stay(rules, name)
        assert paths, name
        for path in paths:
            assert "Bucketed: true" in path[0] and any("Join" in line for line in path) and "Aggregate(key" in path[-1]
            assert not any("Exchange" in line and "Broadcast" not in line for line in path), path
    plain = {n: spark.read.parquet(f"{world['root']}/silver/{n}") for n in tables}
    want = study.rule_signals(cohorts["cohort"], plain, include_vitals=True)
    assert rules.exceptAll(want).isEmpty() and want.exceptAll(rules).isEmpty() and rules.count() > 100


def test_a_hot_key_gets_no_bucket_of_its_own(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("subject_id"), F.lit("IV").alias("route"))
    even = spark.range(3000).select(F.col("id").alias("stay_id"), F.lit(1).alias("itemid"))
    study.to_silver({"emar": rows.withColumn("charttime", F.lit("x")), "inputevents": even}, str(tmp_path), buckets=8)
    out = study.silver_tables(spark, str(tmp_path), ["emar", "inputevents"])
    plan = {n: df.select(df.columns)._jdf.queryExecution().executedPlan().toString() for n, df in out.items()}
    assert out["emar"].count() == out["inputevents"].count() == 3000
    assert "Bucketed: true" in out["inputevents"].groupBy("stay_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" not in plan["emar"]
