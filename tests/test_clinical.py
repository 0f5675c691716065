"""What the causal stage is handed over the raw layout, on rows of its own."""

from datetime import datetime, timedelta

from stayline.bindings import clinical
from stayline.plans import effects, fixed_values as fv, study


def test_a_purchase_before_the_first_signup_has_a_care_unit(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 10)
    kinds = ["click"] * 2 + ["purchase"] * 40
    events = [
        (user * 100 + i, start + timedelta(hours=8 * i), user, "signup" if user and not i else kind, 40.0 + 5 * (i % 9), '{"k": 1}')
        for user in range(3) for i, kind in enumerate(kinds)
    ]
    rows = {
        "events": (events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
        "customer": ([(c, c % 2, "BUILDING") for c in range(3)], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "orders": ([(1, 0, datetime(1995, 1, 1))], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
        "lineitem": ([(1, 1, 1)], "l_orderkey bigint, l_partkey bigint, l_linenumber int"),
        "part": ([(1, "Brand#12", "fan")], "p_partkey bigint, p_brand string, p_name string"),
        "nation": ([(n, "N", 0) for n in range(6)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(r, "R") for r in range(3)], "r_regionkey int, r_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    handed = {}

    def stage(primary, tables):
        handed.update(primary=primary, tables=tables)
        raise effects.EstimationFailed("", {"summary": primary.limit(0).selectExpr(*[f"NULL AS {c}" for c in fv.SUMMARY_COLUMNS])})

    monkeypatch.setattr(effects, "causal_stage", stage)
    clinical.causal_statuses(spark, str(tmp_path))
    eligible = handed["primary"].where("analysis_eligible")
    known = study.covariates(eligible, handed["tables"]).select("task_id", "subject_id", *fv.COVARIATES).collect()
    late = [e for e in events if e[3] == "purchase" and e[1] >= datetime(2024, 1, 16)]
    assert len(known) == sum(e[0] % 11 != no for e in late for no in range(4)) and any(r["subject_id"] == 0 for r in known)
    assert not [r for r in known if None in r]
    assert {(r["subject_id"], r["pre_t0_careunit"]) for r in known} == {(0, "Admission"), (1, '{"k": 1}'), (2, '{"k": 1}')}
