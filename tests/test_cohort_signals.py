from datetime import datetime

from pyspark.sql import functions as F

from helpers import frame, records
from stayline.operators import cohort as co, signals as sg


def small_cohort(spark):
    stays = frame(
        spark, "subject_id bigint, hadm_id bigint, stay_id bigint, icu_intime time, icu_outtime time",
        [
            (1, 10, 102, "2024-01-01", None), (1, 10, 101, "2024-01-01", None), (1, 10, 100, None, None),
            (2, 20, 200, "2024-01-01", None), (2, 21, 201, "2024-02-01", None),
            (3, 30, 300, "2024-01-01", None), (4, 40, 400, "2024-01-01", None), (5, 50, 500, None, None),
        ],
    )
    episodes = frame(
        spark, "subject_id bigint, hadm_id bigint, admittime time, dischtime time",
        [(1, 10, "2024-01-01", None), (2, 21, "2024-02-01", None), (3, 30, "2024-01-01", None),
         (4, 40, "2024-01-01", None), (5, 50, "2024-01-01", None)],
    )
    subjects = spark.createDataFrame(
        [(1, 18), (2, 40), (3, 17), (4, None), (5, 90)], "subject_id bigint, anchor_age int"
    )
    return stays, episodes, subjects


def test_first_stay_rank(spark):
    got = {r["subject_id"]: r for r in records(co.first_stay_cohort(*small_cohort(spark)))}
    # tie on time: lower stay; no episode: later stay; 17 and unknown age are out
    assert {s: r["stay_id"] for s, r in got.items()} == {1: 101, 2: 201, 5: 500}
    assert got[1]["study_window_start"] == datetime(2023, 12, 31)
    assert got[1]["study_window_end"] == datetime(2024, 1, 3)
    assert got[5]["study_window_start"] is None


def test_rank_limit_moves_below_the_shuffle(spark):
    plan = co.first_stay_cohort(*small_cohort(spark))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def window_cohort(spark):
    return frame(
        spark, "subject_id bigint, hadm_id bigint, stay_id bigint, study_window_start time, study_window_end time",
        [(1, 10, 100, "2024-01-01 00:00:00", "2024-01-04 00:00:00"), (2, 20, 200, "2024-01-01", "2024-01-04")],
    )


def test_window_is_closed_and_predicates_are_counted_apart(spark):
    events = frame(
        spark, "subject_id bigint, hadm_id bigint, start time, stop time, v double",
        [
            (1, 10, "2024-01-01 00:00:00", None, 12.1), (1, 10, "2024-01-04 00:00:00", None, 3.9),
            (1, 10, "2023-12-31 23:59:59.999999", None, 1.0), (1, 10, "2024-01-04 00:00:00.000001", None, 1.0),
            (1, 10, None, "2024-01-02", 12.0), (1, 10, "2024-01-02", None, 4.0), (1, 10, "2024-01-02", None, None),
            (1, 11, "2024-01-02", None, 99.0), (1, 10, None, None, 99.0), (2, 20, "2024-01-02", None, 5.0),
        ],
    ).withColumn("at", F.coalesce("start", "stop"))
    out = sg.windowed_signals(
        window_cohort(spark), events, ["subject_id", "hadm_id"], "at",
        {"odd": (F.col("v") < 4) | (F.col("v") > 12), "late": F.col("start").isNull()},
    )
    assert records(out) == [
        {
            "stay_id": 100, "first_odd_time": datetime(2024, 1, 1), "odd_event_count": 2,
            "first_late_time": datetime(2024, 1, 2), "late_event_count": 1,
        }
    ]


def test_first_match_ranks_nulls_last(spark):
    rows = frame(
        spark, "stay_id bigint, seq int, title string",
        [(1, None, "a"), (1, 2, "z"), (1, 2, None), (1, 3, "a")],
    )
    out = sg.first_match(rows, ["seq", "title"], {"t": "title"}, count_name="n")
    assert records(out) == [{"stay_id": 1, "t": "z", "n": 4}]


def test_timed_payload_comes_from_the_first_match(spark):
    events = frame(
        spark, "subject_id bigint, hadm_id bigint, at time, kind string, test string",
        [
            (1, 10, "2024-01-02", None, "b"), (1, 10, "2024-01-02", "x", "z"), (1, 10, "2024-01-02", "x", None),
            (1, 10, "2024-01-01", "skip", "early"), (1, 10, "2023-01-01", "x", "outside"), (2, 20, "2024-01-02", "skip", "b"),
        ],
    )
    out = sg.windowed_signals(
        window_cohort(spark), events, ["subject_id", "hadm_id"], "at", {"any": F.lit(True)},
        [sg.FirstMatch(F.coalesce("kind", F.lit("")) != "skip", ["kind", "test"], {"k": "kind", "t": "test"}, "first", "n")],
    )
    got = {r["stay_id"]: r for r in records(out)}
    assert (got[100]["first"], got[100]["k"], got[100]["t"], got[100]["n"]) == (datetime(2024, 1, 2), "x", "z", 3)
    assert got[100]["any_event_count"] == 4
    assert got[200]["n"] is None and got[200]["k"] is None and got[200]["any_event_count"] == 1


def test_flags_and_sample(spark):
    cohort = window_cohort(spark)
    signal = spark.createDataFrame([(100, 3)], "stay_id bigint, n bigint")
    out = co.attach_signals(cohort, [signal], {"has": "n"})
    assert {r["stay_id"]: (r["has"], r["signal_count"]) for r in records(out)} == {100: (True, 1), 200: (False, 0)}
    assert [r["stay_id"] for r in records(co.with_any_signal(out))] == [100]
    import hashlib

    ids = ["subject_id", "hadm_id", "stay_id"]
    best = min([(1, 10, 100), (2, 20, 200)], key=lambda t: hashlib.md5("-".join(map(str, t)).encode()).hexdigest())
    assert co.hash_sample(cohort, ids, 1).first()["stay_id"] == best[2]


def test_hot_stay_is_split_and_complete(spark):
    """A third of all events on one stay: the join is split, the result is whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        start = F.lit("2024-01-01").cast("timestamp_ntz")
        events = spark.range(0, 90_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("stay_id"),
            (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("at"),
            F.col("id").alias("v"),
        )
        stays = spark.range(50).select(
            F.col("id").alias("stay_id"), start.alias("study_window_start"),
            (start + F.make_dt_interval(F.lit(30))).alias("study_window_end"),
        )
        out = sg.windowed_signals(stays, events, ["stay_id"], "at", {"any": F.col("v") >= 0})
        counts = {r["stay_id"]: r["any_event_count"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(counts.values()) == 90_000
    assert counts[7] == 30_000 + sum(1 for i in range(90_000) if i % 3 and i % 50 == 7)
    assert "skew=true" in plan
