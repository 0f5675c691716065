import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helpers import frame, records
from stayline.operators import asof

ROWS = "task_id string, stay_id bigint, study_window_start time, time_zero time"


def test_lookback_is_half_open_and_ties_go_to_the_later_store_time(spark):
    rows = frame(spark, ROWS, [
        ("a", 1, "2024-01-01", "2024-01-02"), ("b", 2, "2024-01-01", "2024-01-02"), ("c", 3, "2024-01-01", None),
        ("d", 4, "2024-01-01", "2024-01-02"),
    ])
    events = frame(spark, "stay_id bigint, at time, stored time, item int, v double", [
        (1, "2024-01-02", None, 1, 99.0), (1, "2024-01-01", None, 1, 60.0), (1, "2023-12-31", None, 1, 70.0),
        (2, "2024-01-01 10:00", None, 1, 50.0), (2, "2024-01-01 10:00", "2024-01-01 11:00", 1, 40.0),
        (2, "2024-01-01 10:00", "2024-01-01 10:30", 1, 80.0), (2, "2024-01-01 11:00", None, 1, 500.0),
        (2, "2024-01-01 12:00", None, 2, 212.0), (3, "2024-01-01 12:00", None, 1, 70.0),
        (4, "2024-01-01 10:00", None, 1, 30.0), (4, "2024-01-01 10:00", None, 1, 31.0),
    ])
    found = asof.latest_before(
        rows, events, ["stay_id"], "at", order=["stored"],
        values={
            "hr": ((F.col("item") == 1) & F.col("v").between(20, 250), F.col("v")),
            "c": (F.col("item") == 2, (F.col("v") - 32) * 5 / 9),
        },
        flags={"any2": F.col("item") == 2},
    )
    out = records(asof.attach_latest(rows, found, ["stay_id"], flags=["any2"]), "task_id")
    assert [(r["hr"], r["c"], r["any2"]) for r in out] == [
        (60.0, None, False), (40.0, 100.0, True), (None, None, False), (31.0, None, False)
    ]


def test_flags_do_not_fan_out(spark):
    rows = frame(spark, ROWS, [("a", 1, "2024-01-01", "2024-01-02"), ("b", 1, "2024-01-01", "2024-01-02")])
    charts = frame(spark, "stay_id bigint, at time", [(1, "2024-01-01 01:00")] * 50)
    found = asof.latest_before(rows, charts, ["stay_id"], "at", flags={"f": F.lit(True)})
    assert found.count() == 1
    out = asof.attach_latest(rows, found, ["stay_id"], flags=["f"])
    assert [r["f"] for r in records(out)] == [True, True]


def test_prior_counts_equal_the_pairwise_join(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    facts, rows = [], []
    for i in range(600):
        subject = 1 if i % 3 == 0 else rng.randrange(2, 9)
        at = start + timedelta(hours=rng.randrange(0, 400) // 6 * 6)
        facts.append((subject, f"c{rng.randrange(40)}" if rng.random() > 0.1 else None, str(at) if rng.random() > 0.05 else None))
        rows.append((i, subject, str(start + timedelta(hours=rng.randrange(0, 400) // 6 * 6)) if i % 50 else None))
    facts_df = frame(spark, "subject_id bigint, code string, at time", facts)
    rows_df = frame(spark, "id bigint, subject_id bigint, admittime time", rows)
    counts = asof.prior_distinct_counts(
        rows_df, {"n": (facts_df, "code", "at"), "m": (facts_df.where("code < 'c2'"), "code", "at")},
        "subject_id", "admittime",
    )
    got = {r["id"]: (r["n"], r["m"]) for r in records(asof.attach_counts(rows_df, counts, "subject_id", "admittime", ["n", "m"]))}
    assert len(got) == 600
    for i, subject, admit in rows:
        prior = {c for s, c, at in facts if s == subject and c and at and admit and at < admit}
        assert got[i] == (len(prior), len({c for c in prior if c < "c2"}))


def test_latest_equals_the_pairwise_join(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)

    def at(hours):
        return str(start + timedelta(hours=hours))

    events = [(1 if i % 2 else rng.randrange(2, 6), at(rng.randrange(200) / 2), rng.choice([None, 1, 2]), rng.randrange(3), float(rng.randrange(9)))
              for i in range(500)]
    probes = []
    for i in range(150):
        zero = rng.randrange(0, 220) / 2
        probes.append((str(i), rng.randrange(1, 8), at(zero - rng.choice([0, 5, 60])), at(zero)))
    rows = frame(spark, ROWS, probes)
    found = asof.latest_before(
        rows, frame(spark, "stay_id bigint, at time, stored int, item int, v double", events), ["stay_id"], "at", order=["stored"],
        values={"a": (F.col("item") == 0, F.col("v")), "b": (F.col("item") > 0, -F.col("v"))}, flags={"c": F.col("item") == 2},
    )
    out = {r["task_id"]: (r["a"], r["b"], r["c"]) for r in records(asof.attach_latest(rows, found, ["stay_id"], flags=["c"]))}
    for task, stay, first, zero in probes:
        seen = [(t, -1 if o is None else o, item, v) for s, t, o, item, v in events if s == stay and first <= t < zero]
        a = max(((t, o, v) for t, o, item, v in seen if item == 0), default=(None,))[-1]
        b = max(((t, o, -v) for t, o, item, v in seen if item > 0), default=(None,))[-1]
        assert out[task] == (a, b, any(item == 2 for _, _, item, _ in seen)), task


def test_a_subject_with_very_many_probes_and_events(spark):
    step = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)")
    events = spark.range(50_000).select(F.lit(1).alias("stay_id"), step.alias("at"), F.col("id").cast("double").alias("v"))
    probes = spark.range(1, 50_001, 10).select(
        F.lit(1).alias("stay_id"), F.expr("timestamp_ntz'2023-12-31'").alias("study_window_start"), step.alias("time_zero"), "id")
    found = asof.latest_before(probes.drop("id"), events, ["stay_id"], "at", values={"v": (F.col("v") >= 0, F.col("v"))})
    joined = probes.join(found, ["stay_id", "study_window_start", "time_zero"])
    assert joined.where("v = id - 1").count() == joined.count() == 5000


def test_a_hot_key_is_filled_by_many_tasks(spark):
    """One key has a third of all events, all in one day, at uneven moments."""
    n = 30_000
    moment = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(pow(id, 1.3) as int) div 8)"
    hot = spark.range(n).select(F.lit(0).alias("stay_id"), F.expr(moment).alias("at"), F.col("id").alias("v"))
    cold = spark.range(2 * n).select((1 + F.col("id") % 500).cast("int").alias("stay_id"), F.expr(moment).alias("at"), F.col("id").alias("v"))
    events = hot.unionByName(cold)
    asked = events.where("v % 7 = 0").select("stay_id", F.col("at").alias("time_zero"), F.expr("timestamp_ntz'2023-01-01'").alias("study_window_start"))
    cuts = asof.hot_slices(events.select("stay_id", "at"), ["stay_id"], "at", 3000)
    assert [r.stay_id for r in cuts.collect()] == [0]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        cuts = asof.hot_slices(events.select("stay_id", "at"), ["stay_id"], "at", 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    own = F.expr("size(filter(_cuts, c -> c <= at))")
    rows = [r["count"] for r in hot.join(cuts, "stay_id").groupBy(own).count().collect()]
    assert len(rows) == 15 and max(rows) < 1.3 * n / 15
    measures = dict(values={"v": (F.col("v") % 3 > 0, F.col("v"))}, flags={"odd": F.col("v") % 1000 == 1})
    sliced = asof.latest_before(asked, events, ["stay_id"], "at", slice_rows=2000, **measures)
    whole = asof.latest_before(asked, events, ["stay_id"], "at", **measures)
    assert sliced.count() == whole.count() > 10_000
    assert sliced.exceptAll(whole).isEmpty() and whole.exceptAll(sliced).isEmpty()
    # a range without an event takes over from the ones before it
    few = asked.where("stay_id = 0").limit(0).unionByName(
        spark.sql("select 0 stay_id, timestamp_ntz'2024-02-01' time_zero, timestamp_ntz'2023-01-01' study_window_start")
    )
    last = asof.latest_before(few, events.where("v < 20000 OR v % 3 = 0"), ["stay_id"], "at", slice_rows=1000, **measures)
    assert last.select("v", "odd").collect() == [(19999, True)]


def test_events_are_reduced_before_their_shuffle(spark, tmp_path):
    """Few keys are broadcast; many become a Bloom filter below the event side's exchange."""
    spark.range(200_000).select((F.col("id") % 20_000).alias("stay_id"), F.col("id").alias("v")).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    rows = spark.range(0, 20_000, 100).select(F.col("id").alias("stay_id"))
    want = sorted(r.v for r in events.where("stay_id % 100 = 0").collect())
    keys = asof.key_table(rows, ["stay_id"])
    reduced = asof.reduce_to_keys(events, keys, ["stay_id"])
    assert "BroadcastHashJoin" in plan_of(reduced) and sorted(r.v for r in reduced.collect()) == want
    held = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1KB")
        reduced = asof.reduce_to_keys(events, keys, ["stay_id"])
        assert sorted(r.v for r in reduced.collect()) == want
        plan = plan_of(reduced)
        assert "might_contain" in plan and "PushedFilters: [IsNotNull(stay_id), GreaterThanOrEqual(stay_id,0), LessThanOrEqual(stay_id,19900)" in plan
        assert shuffled_rows(reduced) < 2 * len(want)
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert asof.reduce_to_keys(events, rows.limit(0), ["stay_id"]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().toString()


def shuffled_rows(df):
    """The most rows that one exchange of the executed plan wrote."""
    df.collect()
    found = []

    def walk(node):
        if "ShuffleExchange" in node.getClass().getSimpleName():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        else:
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)
