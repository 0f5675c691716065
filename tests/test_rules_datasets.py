import pytest
from pyspark.sql import functions as F

from helpers import frame, records
from stayline.functions.times import earliest
from stayline.operators import checks as ck, datasets as ds, rules
from stayline.plans import fixed_values as fv

SIGNALS = (
    "stay_id bigint, first_note_evidence_time time, first_antibiotic_admin_time time, "
    "first_blood_culture_order_time time, first_lactate_time time, first_note_source string, "
    "first_culture_context_source string, first_diagnosis_source string, first_note_evidence_id string"
)


def labelled(spark, rows):
    df = frame(spark, SIGNALS, rows)
    for c in ("first_abnormal_wbc_time", "first_fever_time", "first_hypotension_time", "first_tachycardia_time"):
        df = df.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    return rules.tiered_label(
        df, tier1=fv.TIER1, tier2=fv.TIER2, tier3=fv.TIER3, sources=fv.SOURCE_PRECEDENCE, evidence=fv.EVIDENCE
    )


def test_tiered_rule(spark):
    day = "2024-01-01 "
    df = labelled(spark, [
        (1, day + "12:00:00", day + "06:00:00", None, None, None, "urinary", "cns", "n1"),
        (2, day + "12:00:00", day + "05:59:59", None, None, "cns", None, None, None),
        (3, None, day + "05:00:00", day + "05:00:00", None, None, None, "cns", None),
        (4, None, day + "06:00:00", day + "05:00:00", day + "01:00:00", None, None, None, None),
        (5, None, None, None, day + "01:00:00", "cns", None, "cns", None),
        (6, None, None, None, None, None, None, "cns", None),
    ])
    got = {r["stay_id"]: r for r in records(df)}
    pick = lambda k: {i: r[k] for i, r in got.items()}
    assert {i: str(t)[11:16] if t else None for i, t in pick("suspicion_time_rule").items()} == {
        1: "12:00", 2: "12:00", 3: "05:00", 4: "05:00", 5: None, 6: None}
    assert pick("rule_confidence") == {1: "high", 2: "medium", 3: "medium", 4: "medium", 5: "low", 6: "low"}
    assert got[3]["suspicion_time_rule_source"] == "tier2_antibiotic_administration"
    assert got[4]["suspicion_time_rule_source"] == "tier2_blood_culture_order"
    assert pick("infection_source_rule") == {1: "urinary", 2: "cns", 3: "cns", 4: None, 5: None, 6: None}
    assert got[3]["infection_source_rule_source"] == "diagnosis_fallback"
    assert got[5]["rule_no_fire_reason"] == "only_tier3_supporting_signals"
    assert got[6]["rule_no_fire_reason"] == "no_tier1_or_tier2_signal"
    assert got[1]["rule_trigger"] == ["tier1_note_evidence", "tier2_antibiotic_administration"]
    assert got[1]["evidence_source"][:3] == ["notes:note_charttime", "notes:text", "notes:note_id"]
    assert ck.rule_traceability(df, [c for _, c in (fv.TIER1, *fv.TIER2)]).first()["violations"] == 0
    broken = df.withColumn("rule_confidence", F.lit("low"))
    assert ck.rule_traceability(broken, [fv.TIER1[1]]).first()["violations"] == 4


def test_treatment_timing(spark):
    df = frame(spark, "id int, z time, a time", [
        (1, "2024-01-01 12:00:00", "2024-01-01 12:00:00"), (2, "2024-01-01 12:00:00", "2024-01-01 15:00:00"),
        (3, "2024-01-01 12:00:00", "2024-01-01 15:00:01"), (4, "2024-01-01 12:00:00", "2024-01-01 11:59:59"),
        (5, "2024-01-01 12:00:00", None), (6, None, "2024-01-01 12:00:00"),
    ])
    out = records(df.withColumns(ds.treatment_columns(F.col("z"), F.col("a"), 3)), "id")
    assert [r["treatment_timing_category"] for r in out] == [
        "within_window", "within_window", "after_window", "before_time_zero", "no_antibiotic", "no_time_zero"]
    assert [r["early_antibiotic_within_window"] for r in out] == [True, True, False, None, False, None]
    assert [r["treatment_before_time_zero"] for r in out] == [False, False, False, True, False, False]
    assert out[2]["treatment_delay_hours"] == 3.000278


def test_outcome(spark):
    df = frame(spark, "id int, z time, d time", [
        (1, "2024-01-01", "2024-01-01"), (2, "2024-01-01", "2024-01-29"), (3, "2024-01-01", "2024-01-29 00:00:01"),
        (4, "2024-01-01", "2023-12-31"), (5, "2024-01-01", None), (6, None, "2024-01-01"),
    ])
    out = records(df.withColumns(ds.outcome_columns(F.col("z"), F.col("d"))), "id")
    assert [r["mortality_28d"] for r in out] == [True, True, False, None, False, None]
    assert [r["followup_duration_days"] for r in out] == [0.0, 28.0, 28.0, None, 28.0, None]
    assert [r["death_before_time_zero"] for r in out] == [False, False, False, True, False, False]


def test_date_only_death_is_midnight(spark):
    df = frame(spark, "a time, b time", [("2024-01-05 10:00", "2024-01-05"), (None, "2024-01-05"), ("2024-01-05 10:00", None)])
    got = [str(r[0]) for r in df.select(earliest(F.col("a"), F.col("b"))).collect()]
    assert got == ["2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-05 10:00:00"]


def dataset(spark):
    rows = frame(
        spark,
        "task_id string, predictor_name string, predictor_type string, predictor_id string, suspicion_time time, "
        "analysis_eligible boolean, analysis_exclusion_reason string, first_antibiotic_time time, death_time time, "
        "icu_intime time, study_window_start time, study_window_end time",
        [
            ("a", "gold", "gold", "g", "2024-01-03 22:00:00", True, None, "2024-01-04 01:00:00", None,
             "2024-01-02", "2024-01-01", "2024-01-04"),
            ("b", "gold", "gold", "g", None, False, "missing_time_zero", None, None, "2024-01-02", "2024-01-01", "2024-01-04"),
        ],
    )
    for c in ("treatment_timing_category", "analysis_exclusion_reason"):
        rows = rows.withColumn(c, F.lit(None).cast("string")) if c not in rows.columns else rows
    return ds._derived(rows, 3.0)


def test_shift_recomputes_and_flags_the_window(spark):
    out = {(r["task_id"], r["synthetic_shift_hours"]): r for r in records(ds.shift_time_zero(dataset(spark), [-1.0, 2.0, 2.5]))}
    assert len(out) == 6
    assert out["a", 2.0]["analysis_exclusion_reason"] is None  # closed window end
    assert out["a", 2.5]["analysis_exclusion_reason"] == "shifted_time_zero_outside_study_window"
    assert out["b", 2.0]["analysis_exclusion_reason"] == "missing_time_zero"
    assert out["a", 2.5]["predictor_name"] == "synthetic_gold_plus2p5h"
    assert out["a", 2.5]["predictor_id"] == "gold|shift=2.5"
    assert out["a", -1.0]["treatment_delay_hours"] == 4.0
    assert out["a", -1.0]["treatment_timing_category"] == "after_window"
    with pytest.raises(ValueError):
        ds.shift_time_zero(dataset(spark), [0.0])
    with pytest.raises(ValueError):
        ds.selected_predictors(dataset(spark), ["gold", "nobody"])


def test_shift_and_back_gives_the_original(spark):
    base = dataset(spark)
    there = ds.shift_time_zero(base, [2.5]).drop(*ds.SHIFT_COLUMNS)
    back = ds.shift_time_zero(there, [-2.5]).drop(*ds.SHIFT_COLUMNS)
    same = [c for c in base.columns if not c.startswith("predictor")]
    assert records(back.select(*same), "task_id") == records(base.select(*same), "task_id")
