import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import frame, records
from stayline.operators import checks as ck, extraction as ex, labels as lb, notes as nt


@pytest.mark.parametrize("n, f, k", [(5, 0.5, 2), (3, 0.1, 1), (4, 2.0, 4), (0, 0.5, 0), (5, 0.0, 0), (7, 0.5, 4)])
def test_overlap_size(n, f, k):
    assert lb.overlap_size(n, f) == k


def test_assignment_is_round_robin_in_hash_order(spark):
    tasks = [f"t{i}" for i in range(23)]
    panel = ["a", "b", "c"]
    got = lb.assign_reviewers(spark.createDataFrame([(t,) for t in tasks], "task_id string"), panel, fraction=0.3, seed="s")
    order = sorted(tasks, key=lambda t: hashlib.md5(f"s-{t}".encode()).hexdigest())
    want = {(t, panel[i % 3], "primary") for i, t in enumerate(order)}
    want |= {(t, panel[(i % 3 + 1 + i % 2) % 3], "secondary") for i, t in enumerate(order[:7])}
    assert {tuple(r) for r in got.collect()} == want
    counts = {r["reviewer_id"]: r["assignment_count"] for r in records(lb.assignment_counts(got))}
    assert sum(counts.values()) == 30


REVIEW = (
    "task_id string, reviewer_id string, annotation_status string, suspected_sepsis string, suspicion_time string, "
    "infection_source string, evidence_span string, confidence string, reviewed_at string"
)
YES = ("yes", "2024-01-01 10:00", "Lung", "cough", "0.8")


def test_row_status_and_contract(spark):
    rows = spark.createDataFrame([
        ("1", "r", "pending", "", "", "", "", "", ""), ("2", "r", "pending", *YES, ""), ("3", "r", "skipped", "", "", "", "", "", ""),
        ("4", "r", "skipped", *YES, ""), ("5", "r", "completed", "no", "", "", "", "1", "2024-01-01"),
        ("6", "r", "completed", "no", "2024-01-01", "", "", "1", ""), ("7", "r", "completed", "yes", "", "x", "y", "1", ""),
        ("8", "r", "completed", "yes", "soon", "x", "y", "1", ""), ("9", "r", "Completed", "maybe", "", "", "", "1", ""),
        ("a", "r", "completed", "no", "", "", "", "1.1", ""), ("b", "r", "odd", "", "", "", "", "", ""),
        ("c", "r", "completed", "no", "", "", "", "0", "later"),
    ], REVIEW)
    got = {r["task_id"]: (r["row_status"], r["reject_reason"]) for r in records(lb.normalized_annotations(rows))}
    assert got == {
        "1": ("pending", None), "2": ("completed", None), "3": ("skipped", None), "4": ("completed", "unsupported_status"),
        "5": ("completed", None), "6": ("completed", "negative_with_time"), "7": ("completed", "positive_without_time"),
        "8": ("completed", "unreadable_time"), "9": ("completed", "unreadable_boolean"),
        "a": ("completed", "unreadable_confidence"), "b": ("completed", "unsupported_status"),
        "c": ("completed", "unreadable_review_time"),
    }
    with pytest.raises(ck.ContractError, match="rejected_annotation=8"):
        ck.enforce(ck.rejected_annotations(lb.normalized_annotations(rows)))


def test_resolution_precedence_and_merge(spark):
    done = "completed"
    reviews = spark.createDataFrame([
        ("single", "r1", done, *YES, "2024-02-01"),
        ("agree", "r2", done, "1", "2024-01-01T10:00:00", " LUNG ", "Cough ", "0.6", "2024-02-03"),
        ("agree", "r1", done, *YES, "2024-02-01"),
        ("core", "r1", done, *YES, ""), ("core", "r2", done, "yes", "2024-01-01 10:00", "lung", "fever", "0.9", ""),
        ("conflict", "r1", done, *YES, ""), ("conflict", "r2", done, "no", "", "", "", "0.9", ""),
        ("waiting", "r1", done, *YES, ""), ("judged", "r1", done, *YES, ""),
    ], REVIEW)
    annotations = lb.normalized_annotations(reviews)
    tasks = spark.createDataFrame([(t,) for t in ("single", "agree", "core", "conflict", "waiting", "judged", "none")], "task_id string")
    expected = lb.expected_reviewers(spark.createDataFrame(
        [("waiting", "r1"), ("waiting", "r9"), ("judged", "r9"), ("single", "r1")], "task_id string, reviewer_id string"))
    final = lb.normalized_annotations(spark.createDataFrame(
        [("judged", "j", "no", "", "", "", "1", "2024-03-01")],
        "task_id string, adjudicator_id string, final_suspected_sepsis string, final_suspicion_time string, "
        "final_infection_source string, final_evidence_span string, final_confidence string, adjudicated_at string"),
        prefix="final_", status=None, reviewed="adjudicated_at")
    resolved = lb.resolved_labels(tasks, annotations, expected, final)
    got = {r["task_id"]: r for r in records(resolved)}
    assert {t: r["resolution_status"] for t, r in got.items()} == {
        "single": "single_review", "agree": "reviewer_agreement", "core": "reviewer_core_agreement",
        "conflict": "needs_adjudication", "waiting": "awaiting_assigned_review", "judged": "adjudicated",
        "none": "missing_annotation"}
    assert got["agree"]["infection_source"] == "Lung" and got["agree"]["evidence_span"] == "cough"
    assert got["agree"]["confidence"] == 0.7 and got["agree"]["reviewed_at"] == "2024-02-03 00:00:00"
    assert got["agree"]["final_reviewer_id"] == "r1|r2"
    assert got["core"]["evidence_span"] == "cough || fever"
    assert got["judged"]["suspected_sepsis"] is False and got["judged"]["source_annotation_count"] == 2
    assert got["judged"]["supporting_reviewer_ids"] == ["r1", "j"] and got["judged"]["missing_expected_reviewers"] == []
    assert got["waiting"]["missing_expected_reviewers"] == ["r9"]
    assert got["conflict"]["suspected_sepsis"] is None
    summary = lb.label_summary(resolved).first()
    assert summary["double_review_exact_agreement_rate"] == 0.333333
    assert (summary["finalized_task_count"], summary["blocking_task_count"], summary["missing_assigned_review_count"]) == (4, 3, 1)
    wide = records(lb.adjudication_table(resolved, ["task_id"]))
    assert len(wide) == 1 and wide[0]["reviewer_2_suspected_sepsis"] == "false" and "reviewer_3_id" not in wide[0]
    assert wide[0]["final_confidence"] == ""
    # without expectations and adjudications
    plain = {r["task_id"]: r["resolution_status"] for r in records(lb.resolved_labels(tasks, annotations))}
    assert plain["judged"] == plain["waiting"] == "single_review"


def linked(spark):
    rows = [(1, "b", "2024-01-01 02:00", "y" * 2000), (1, "a", "2024-01-01 01:00", "x" * 39000), (1, "c", "2024-01-01 03:00", "z" * 500),
            (2, "n2", None, " late "), (2, None, "2024-01-01 01:00", "early"), (None, "q", "2024-01-01", "lost"), (3, "e", "2024-01-01", None)]
    return frame(spark, "stay_id bigint, note_id string, note_charttime time, text string", rows).withColumns(
        {"subject_id": F.col("stay_id"), "hadm_id": F.col("stay_id")})


def test_budget_stops_at_the_first_note_over_it(spark):
    kept = nt.budgeted_notes(linked(spark))
    assert {(r["stay_id"], r["note_id"]) for r in records(kept)} == {(1, "a"), (2, None), (2, "n2")}
    assert {(r["stay_id"], r["note_rank"]) for r in records(nt.budgeted_notes(linked(spark), max_notes=1))} == {(1, 1), (2, 1)}
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_bundle_and_prompt(spark):
    tasks = nt.note_bundles(nt.budgeted_notes(linked(spark)))
    row = tasks.where("stay_id = 2").withColumn("text", nt.rendered_notes(F.col("notes"))).first()
    assert (row["task_id"], row["note_count"], row["first_note_time"], row["last_note_time"]) == (
        "stay-2", 2, "2024-01-01 01:00:00", None)
    assert row["text"] == (
        "[Note 1]\nnote_id: note-1\ncharttime: 2024-01-01 01:00:00\ntext:\nearly\n\n"
        "[Note 2]\nnote_id: n2\ncharttime: unknown\ntext:\nlate")
    assert row["annotation_template"]["confidence"] is None


def test_missing_ids_and_equal_times_have_a_fixed_order(spark):
    rows = frame(spark, "stay_id bigint, note_id string, note_charttime time, text string", [
        (1, None, "2024-01-01", "b"), (1, "z", "2024-01-01", "c"), (1, None, "2024-01-01", "a"), (1, "y", None, "d")])
    rows = rows.withColumns({"subject_id": F.col("stay_id"), "hadm_id": F.col("stay_id")})
    notes = nt.note_bundles(nt.budgeted_notes(rows)).first()["notes"]
    assert [n["text"] for n in notes] == ["c", "a", "b", "d"]
    assert {r["text"] for r in records(nt.budgeted_notes(rows, max_notes=2))} == {"c", "a"}


def test_domain_policy(spark):
    schema = "domain string, parquet_path string, allowed_for_gold_annotations boolean, reason string"
    none = spark.createDataFrame([("rad", "/r", False, "secondary")], schema)
    one = spark.createDataFrame([("rad", "/r", True, None), ("dis", "/d", False, "late")], schema)
    with pytest.raises(ValueError):
        nt.choose_notes(none)
    with pytest.raises(FileNotFoundError):
        nt.choose_notes(None)
    with pytest.raises(ValueError):
        nt.choose_notes(one, "/d")
    assert nt.choose_notes(one) == ("/r", "manifest_approved")
    assert nt.choose_notes(one, "/r") == ("/r", "explicit_manifest_match")
    assert nt.choose_notes(one, "/d", allow_nonprimary=True) == ("/d", "explicit_nonprimary_override")
    assert nt.choose_notes(one, "/x") == ("/x", "explicit_path")


def test_answers(spark):
    good = {"suspected_sepsis": "yes", "suspicion_time": "2024-01-01T10:00:00Z", "infection_source": " lung ",
            "evidence_span": "x", "confidence": 0.123456789}
    answers = [
        ("prose { broken " + json.dumps(good) + json.dumps({"a": 1}), "ok", None),
        ("nothing here", "parse_error", "no_json_object"), (None, "parse_error", "no_json_object"),
        ("[1, {\"a\": 2}]", "schema_error", "missing_keys"),
        (json.dumps({**good, "confidence": 1.2}), "request_error", "unreadable_confidence"),
        (json.dumps({**good, "suspicion_time": "soon"}), "request_error", "unreadable_time"),
        (json.dumps({**good, "suspected_sepsis": "perhaps"}), "request_error", "unreadable_boolean"),
        (json.dumps({**good, "infection_source": None}), "schema_error", "positive_without_details"),
        (json.dumps({**good, "suspected_sepsis": False, "evidence_span": None}), "ok", None),
        ("{" * 2000, "parse_error", "no_json_object"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(answers)], "i int, raw_response_text string")
    got = records(ex.parsed_answers(df), "i")
    assert [(r["extraction_status"], r["error_kind"]) for r in got] == [(s, e) for _, s, e in answers]
    assert got[0]["normalized_extraction"].asDict() == {
        "suspected_sepsis": True, "suspicion_time": "2024-01-01 10:00:00+00:00", "infection_source": "lung",
        "evidence_span": "x", "confidence": 0.123457}
    assert got[8]["normalized_extraction"]["infection_source"] is None


def _decoded(text):
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            found = None
        if isinstance(found, dict):
            return found
        at = text.find("{", at + 1)
    return None


def test_first_json_object_against_the_decoder(spark):
    rng = random.Random(3)
    parts = ["{", "}", '"', "a", ":", ",", "1", " ", "\n", "\\", "[", "]", '{"a":', '{"b":2}', '"x"', "null", "true", "\u00e9", "'"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ['say {this} {"a": "x"} end', '{"a":1,"a":2}', '{"a": {"b": 1}, oops} tail', "{'a': 1}", '{"a":"never ends', "", "{" * 2000]
    members = ex.first_json_object(F.col("text"))
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string").select(
        "i", members.isNull().alias("none"), ex.member(members, "a").alias("a"), ex.member(members, "b").alias("b")
    )
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()

    def text_of(value):
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    wanted = [_decoded(t) for t in texts] + [None]
    assert sum(w is not None for w in wanted) > 500
    got = sorted(df.collect())
    assert [tuple(r) for r in got] == [
        (i, w is None, *(text_of(w.get(k)) if w is not None else None for k in "ab")) for i, w in enumerate(wanted)
    ]
