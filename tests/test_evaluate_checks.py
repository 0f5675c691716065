import pytest
from pyspark.sql import functions as F

from helpers import frame, records
from stayline.operators import checks as ck, evaluate as ev

FIELDS = "task_id string, suspected_sepsis boolean, suspicion_time time, infection_source string, evidence_span string, confidence double, st string"


def rows(spark, name, kind, data):
    df = frame(spark, FIELDS, [(t, p, at, s, None, None, st) for t, p, at, s, st in data])
    return ev.as_predictor(df, name, kind, name + "_id", status=F.col("st"))


def gold(spark):
    return frame(
        spark, "task_id string, suspected_sepsis boolean, suspicion_time time, infection_source string",
        [("1", True, "2024-01-01 10:00", "Lung"), ("2", True, "2024-01-01 10:00", None), ("3", False, None, None),
         ("4", False, None, None), ("5", True, None, "x")],
    )


def test_metrics(spark):
    never = rows(spark, "never", "model", [(str(i), False, None, None, "ok") for i in range(1, 6)])
    some = rows(spark, "some", "model", [
        ("1", True, "2024-01-01 11:00", " lung ", "ok"), ("2", True, "2024-01-01 13:00:01", "y", "ok"),
        ("3", True, "2024-01-01 10:00", None, "ok"), ("4", False, None, None, " "), ("5", False, None, None, "ok"),
        ("99", True, None, None, "ok")])
    broken = rows(spark, "broken", "model", [("1", True, None, None, "schema_error")])
    got = {r["predictor_name"]: r for r in records(ev.evaluate_predictors(gold(spark), ev.stacked([never, some, broken])))}
    n, s, b = got["never"], got["some"], got["broken"]
    assert n["precision"] is None and n["recall"] == 0 and n["f1_score"] is None
    assert n["exact_label_match_rate"] == 0.4 and n["source_eval_count"] == 0 and n["infection_source_agreement_rate"] is None
    assert (s["true_positive_count"], s["false_positive_count"], s["false_negative_count"], s["true_negative_count"]) == (2, 1, 1, 0)
    assert s["valid_prediction_count"] == 4 and s["valid_prediction_rate"] == 0.8
    assert (s["precision"], s["recall"], s["f1_score"]) == (0.666667, 0.666667, 0.666667)
    assert s["median_time_error_hours"] == s["mean_time_error_hours"] == 2.000139
    assert (s["within_1h_rate"], s["within_3h_rate"]) == (0.5, 0.5)
    assert (s["source_eval_count"], s["infection_source_agreement_rate"]) == (1, 1.0)
    assert b["valid_prediction_count"] == 0 and b["valid_prediction_rate"] == 0 and b["evaluated_task_count"] == 5
    assert b["precision"] is None and b["exact_label_match_rate"] is None


def test_two_definitions_of_disagreement(spark):
    a = [("gap1h", True, "2024-01-01 10:00:00", "Lung", "ok"), ("gap+", True, "2024-01-01 10:00:00", "x", "ok"),
         ("onetime", True, "2024-01-01 10:00:00", "x", "ok"), ("case", True, "2024-01-01 10:00:00", "Lung", "ok"),
         ("nosrc", False, None, None, "ok"), ("class", False, None, None, "ok"), ("onlya", True, None, None, "ok"),
         ("bad", True, None, "x", "parse_error")]
    b = [("gap1h", True, "2024-01-01 11:00:00", "Lung", "ok"), ("gap+", True, "2024-01-01 11:00:01", "x", "ok"),
         ("onetime", True, None, "x", "ok"), ("case", True, "2024-01-01 10:00:00", "lung ", "ok"),
         ("nosrc", False, None, "y", "ok"), ("class", True, None, None, "ok"), ("bad", False, None, "y", "ok")]
    both = ev.stacked([rows(spark, "a", "model", a), rows(spark, "b", "model", b)])
    pair = records(ev.pairwise_disagreement(both, ["b", "a"]))
    assert len(pair) == 1 and (pair[0]["left_predictor"], pair[0]["right_predictor_id"]) == ("b", "a_id")
    assert pair[0]["shared_task_count"] == 7
    assert pair[0]["classification_disagreement_count"] == 1
    assert pair[0]["classification_disagreement_rate"] == 0.142857
    assert (pair[0]["source_disagreement_count"], pair[0]["time_disagreement_over_1h_count"]) == (0, 1)
    material = {r["task_id"] for r in records(ev.material_disagreement(both.where("task_id <> 'bad'"), ["a", "b"]))}
    assert material == {"gap+", "onetime", "case", "nosrc", "class"}
    assert {r["task_id"] for r in records(ev.shared_tasks(both, ["a", "b"]))} == {t for t, *_ in a} - {"onlya"}


def test_rule_predictions_follow_the_stay(spark):
    rules = frame(spark, "stay_id bigint, suspicion_time_rule time, infection_source_rule string",
                  [(1, "2024-01-01", " "), (2, None, None), (9, "2024-01-01", "x")])
    tasks = spark.createDataFrame([("t1", 1), ("t2", 2)], "task_id string, stay_id bigint")
    got = records(ev.rule_predictions(rules, tasks), "task_id")
    assert [(r["task_id"], r["suspected_sepsis"], r["infection_source"]) for r in got] == [("t1", True, None), ("t2", False, None)]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "5.0"), (4, "7")], "k bigint, v string")
    count = lambda c: {r["check"]: r["violations"] for r in records(c)}
    assert count(ck.duplicate_keys(df, "dup", ["k"])) == {"dup": 1}
    assert count(ck.unparsable_integers(df, "int", ["v"])) == {"int": 3}
    other = spark.createDataFrame([(1,), (9,)], "k bigint")
    assert count(ck.coverage(df, other, "cov", "k")) == {"cov_missing": 3, "cov_extra": 1}
    assert {r["k"] for r in records(ck.missing_keys(df, other, "k"))} == {2, 3, 4}
    assert count(ck.unknown_keys(df, other, "unknown", "k")) == {"unknown": 3}
    assert count(ck.missing_values(df, ["k", "v"])) == {"missing_k": 0, "missing_v": 1}
    ck.enforce(ck.duplicate_keys(other, "dup", ["k"]))
    with pytest.raises(ck.ContractError, match="dup=1"):
        ck.enforce(ck.duplicate_keys(df, "dup", ["k"]), ck.duplicate_keys(other, "other", ["k"]))
    with pytest.raises(ck.ContractError, match="missing required columns: z"):
        ck.require_columns(df, ["k", "z"], "frame")
    ck.same_schema("x", ["a", "extra", "b"], ["a", "b"], ["extra"])
    for columns in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(ck.ContractError):
            ck.same_schema("x", columns, ["a", "b"])
    counts = {r["table_name"]: (r["row_count"], r["distinct_keys"]) for r in records(ck.table_counts({"df": df, "gone": None}, {"df": "k"}))}
    assert counts == {"df": (5, 4), "gone": (0, 0)}


def test_label_contract(spark):
    df = spark.createDataFrame(
        [(True, "t", "s", "e"), (True, None, "s", "e"), (True, "t", "s", None), (False, None, None, "e"), (False, "t", None, None)],
        "suspected_sepsis boolean, suspicion_time string, infection_source string, evidence_span string")
    assert ck.label_contract(df).first()["violations"] == 3


def test_time_zero_window_check(spark):
    df = frame(spark, "suspicion_time time, study_window_start time, study_window_end time", [
        ("2024-01-01", "2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-01", "2024-01-02"),
        ("2024-01-03", "2024-01-01", "2024-01-02"), ("2024-01-01", None, None), (None, None, None)])
    assert ck.time_zero_outside_window(df).first()["violations"] == 2
