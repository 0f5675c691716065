"""Analysis datasets, time-zero shifts and typing bindings.

Each predictor reads one event type: positive when the user has a strong event of that
type inside the study window, time zero at the first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.bindings import Bound, micros, table, with_micros
from stayline.bindings.timelines import sql_users, user_cohort, user_events
from stayline.functions.times import add_hours, earliest, shift_label, time_text
from stayline.functions.typing import blank_to_null, optional_column, typed
from stayline.operators import datasets as ds, signals as sg
from stayline.sources.tables import empty_table

_T = "%Y-%m-%d %H:%M:%S.%f"

PANEL = (
    ("gold", "gold", "click"),
    ("x_rule", "rule_based", "view"),
    ("model_1", "model", "error"),
    ("model_2", "model", "signup"),
)
SHIFTS = (-3.0, -2.0, -1.0, 1.0, 2.0, 3.0, 30.5)


def tasks(spark, sf) -> DataFrame:
    """The users' stays as tasks, with treatment, death and a few descriptive columns."""
    cohort = user_cohort(spark, sf, 24, 240)
    events = user_events(spark, sf)
    kind, v = F.col("event_type"), F.col("value")
    treated = sg.windowed_signals(
        cohort, events, ["subject_id"], "ts", {"antibiotic": (kind == "purchase") & (v >= 20)}
    )
    deaths = events.groupBy("subject_id").agg(
        F.min(F.when((kind == "error") & (v >= 150), F.col("ts"))).alias("deathtime"),
        F.to_date(F.min(F.when((kind == "purchase") & (v >= 180), F.col("ts"))))
        .cast("timestamp_ntz")
        .alias("dod"),
    )
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        (F.col("c_nationkey") + 20).alias("anchor_age"),
        F.col("c_mktsegment").alias("admission_type"),
    )
    return (
        cohort.withColumn("task_id", F.concat(F.lit("stay-"), F.col("stay_id").cast("string")))
        .join(treated, "stay_id", "left")
        .join(deaths, "subject_id", "left")
        .join(people, "subject_id", "left")
        .withColumn("death_time", earliest(F.col("deathtime"), F.col("dod")))
    )


def predictions(spark, sf) -> DataFrame:
    """Long predictor relation: one row per (task, predictor)."""
    cohort = user_cohort(spark, sf, 24, 240)
    strong = sg.in_window(
        cohort, user_events(spark, sf).where(F.col("value") >= 60), ["subject_id"], "ts"
    )
    panel = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(event).alias("event")
            )
            for name, kind, event in PANEL
        ]
    )
    asked = cohort.select("stay_id", F.explode(panel).alias("p")).select(
        "stay_id",
        F.col("p.name").alias("predictor_name"),
        F.col("p.type").alias("predictor_type"),
        F.concat(F.col("p.name"), F.lit("_id")).alias("predictor_id"),
        F.col("p.event").alias("event_type"),
    )
    first = strong.groupBy("stay_id", "event_type").agg(
        F.min_by(F.struct("ts", "value", "props"), F.struct("ts", "event_id")).alias("f")
    )
    source = F.when(F.col("f.value") > 100, F.lit(" Lung")).when(F.col("f.value") > 80, F.lit("urine "))
    return asked.join(first, ["stay_id", "event_type"], "left").select(
        F.concat(F.lit("stay-"), F.col("stay_id").cast("string")).alias("task_id"),
        "predictor_name", "predictor_type", "predictor_id",
        F.lit("ok").alias("prediction_status"),
        F.col("f").isNotNull().alias("suspected_sepsis"),
        F.col("f.ts").alias("suspicion_time"),
        source.alias("infection_source"),
        F.col("f.props").alias("evidence_span"),
        F.least(F.lit(1.0), F.col("f.value") / 500).alias("confidence"),
    )


def datasets(spark, sf) -> DataFrame:
    cohort = tasks(spark, sf)
    gold = cohort.select("task_id", "subject_id", "hadm_id", "stay_id")
    return ds.analysis_datasets(predictions(spark, sf), gold, cohort)


_OUTCOME_COLUMNS = [
    "task_id", "subject_id", "stay_id", "predictor_name", "predictor_type", "predictor_id",
    "suspected_sepsis", "suspicion_time", "infection_source", "evidence_span",
    "analysis_eligible", "analysis_exclusion_reason", "treatment_timing_category",
    "early_antibiotic_within_window", "treatment_delay_hours", "treatment_before_time_zero",
    "death_time", "death_delay_days", "death_before_time_zero", "mortality_28d",
    "followup_duration_days", "hours_from_icu_to_time_zero", "first_antibiotic_time",
    "antibiotic_event_count", "anchor_age", "admission_type",
]
_OUTCOME_TIMES = ["suspicion_time", "death_time", "first_antibiotic_time"]


def treatment_outcome(spark, sf):
    return with_micros(datasets(spark, sf).select(*_OUTCOME_COLUMNS), *_OUTCOME_TIMES)


def dataset_summary(spark, sf):
    return ds.dataset_summary(datasets(spark, sf))


def _sql_round6(x: str) -> str:
    """Six decimals of the exact binary value, ties to even, in 128-bit integers.

    Scaling a double by a power of two is exact; SQL ``round`` works on a rounded product.
    """
    bits = f"(CAST(abs({x}) * 4611686018427387904.0::DOUBLE AS HUGEINT) * 1000000::HUGEINT)"
    whole = f"({bits} // 4611686018427387904::HUGEINT)"
    rest = f"({bits} % 4611686018427387904::HUGEINT)"
    half = "2305843009213693952::HUGEINT"
    up = f"CASE WHEN {rest} > {half} OR ({rest} = {half} AND {whole} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(sign({x}) * CAST({whole} + {up} AS DOUBLE) / 1000000.0::DOUBLE)"


def _derived_sql(zero: str, outside: str | None) -> str:
    delay = f"((epoch_us(ab) - epoch_us({zero})) / 3600000000.0)"
    death = f"((epoch_us(death) - epoch_us({zero})) / 86400000000.0)"
    icu = f"(epoch_us({zero}) - epoch_us(icu)) / 3600000000.0"
    extra = f"CASE WHEN {outside} THEN 'shifted_time_zero_outside_study_window' END," if outside else ""
    reasons = (
        f"nullif(concat_ws('|', CASE WHEN {zero} IS NULL THEN 'missing_time_zero' END, {extra}"
        f" CASE WHEN {delay} < 0 THEN 'treatment_before_time_zero' END,"
        f" CASE WHEN {death} < 0 THEN 'death_before_time_zero' END), '')"
    )
    return f"""
  {reasons} IS NULL AS analysis_eligible, {reasons} AS analysis_exclusion_reason,
  CASE WHEN {zero} IS NULL THEN 'no_time_zero' WHEN ab IS NULL THEN 'no_antibiotic'
    WHEN {delay} < 0 THEN 'before_time_zero' WHEN {delay} <= 3 THEN 'within_window' ELSE 'after_window' END AS treatment_timing_category,
  CASE WHEN {zero} IS NULL OR {delay} < 0 THEN NULL WHEN ab IS NULL THEN false ELSE {delay} <= 3 END AS early_antibiotic_within_window,
  {_sql_round6(delay)} AS treatment_delay_hours, coalesce({delay} < 0, false) AS treatment_before_time_zero,
  {_sql_round6(death)} AS death_delay_days, coalesce({death} < 0, false) AS death_before_time_zero,
  CASE WHEN {zero} IS NULL OR {death} < 0 THEN NULL ELSE coalesce({death} <= 28, false) END AS mortality_28d,
  CASE WHEN {zero} IS NULL OR {death} < 0 THEN NULL WHEN {death} <= 28 THEN {_sql_round6(death)} ELSE 28.0 END AS followup_duration_days,
  {_sql_round6(icu)} AS hours_from_icu_to_time_zero"""


SQL_DATASETS = sql_users(24, 240) + """,
ab AS (SELECT stay_id, min(ts) ab, count(*) ab_n FROM users JOIN events ON user_id = subject_id
  WHERE ts BETWEEN ws AND we AND event_type = 'purchase' AND value >= 20 GROUP BY 1),
dead AS (SELECT user_id, min(ts) FILTER (event_type = 'error' AND value >= 150) AS dt,
  CAST(CAST(min(ts) FILTER (event_type = 'purchase' AND value >= 180) AS DATE) AS TIMESTAMP) AS dod FROM events GROUP BY 1),
task AS (SELECT 'stay-' || u.stay_id AS task_id, u.*, ab.ab, ab.ab_n, u.icu_intime AS icu,
  CASE WHEN dt IS NOT NULL AND dod IS NOT NULL THEN least(dt, dod) ELSE coalesce(dt, dod) END AS death,
  c_nationkey + 20 AS anchor_age, c_mktsegment AS admission_type
  FROM users u LEFT JOIN ab ON ab.stay_id = u.stay_id LEFT JOIN dead ON dead.user_id = u.subject_id
  LEFT JOIN customer ON c_custkey = u.subject_id),
panel AS (SELECT * FROM (VALUES ('gold', 'gold', 'click'), ('x_rule', 'rule_based', 'view'),
  ('model_1', 'model', 'error'), ('model_2', 'model', 'signup')) t(name, type, event)),
strong AS (SELECT * FROM (SELECT stay_id, e.event_type, e.ts, e.value, e.props,
  row_number() OVER (PARTITION BY stay_id, event_type ORDER BY ts, event_id) rk
  FROM users JOIN events e ON user_id = subject_id WHERE ts BETWEEN ws AND we AND value >= 60) WHERE rk = 1),
pred AS (SELECT task_id, t.stay_id, t.subject_id, name AS predictor_name, type AS predictor_type, name || '_id' AS predictor_id,
  s.ts IS NOT NULL AS suspected_sepsis, s.ts AS said_at, CASE WHEN value > 100 THEN ' Lung' WHEN value > 80 THEN 'urine ' END AS src,
  props, t.ab, t.ab_n, t.death, t.icu, t.ws, t.we, anchor_age, admission_type
  FROM task t CROSS JOIN panel LEFT JOIN strong s ON s.stay_id = t.stay_id AND s.event_type = panel.event),
ds0 AS (SELECT *, date_trunc('second', said_at) AS zero FROM pred),
ds AS (SELECT task_id, subject_id, stay_id, predictor_name, predictor_type, predictor_id, suspected_sepsis, zero,
  nullif(trim(src), '') AS infection_source, props AS evidence_span, """ + _derived_sql("zero", None) + f""",
  date_trunc('second', death) AS death, date_trunc('second', ab) AS ab, ab_n AS antibiotic_event_count, anchor_age, admission_type,
  date_trunc('second', icu) AS icu, date_trunc('second', ws) AS ws, date_trunc('second', we) AS we FROM ds0)"""

_SQL_OUTCOME = "WITH" + SQL_DATASETS + f"""
SELECT * EXCLUDE (zero, death, ab, icu, ws, we), strftime(zero, '{_T}') AS suspicion_time,
  strftime(death, '{_T}') AS death_time, strftime(ab, '{_T}') AS first_antibiotic_time FROM ds"""

_SQL_DATASET_SUMMARY = "WITH" + SQL_DATASETS + """
SELECT predictor_name, predictor_type, predictor_id, count(*) AS row_count,
  count(*) FILTER (suspected_sepsis) AS suspected_sepsis_count,
  count(*) FILTER (analysis_eligible) AS analysis_eligible_count,
  count(*) FILTER (analysis_exclusion_reason = 'missing_time_zero') AS missing_time_zero_count,
  count(*) FILTER (treatment_before_time_zero) AS treatment_before_time_zero_count,
  count(*) FILTER (death_before_time_zero) AS death_before_time_zero_count,
  count(*) FILTER (early_antibiotic_within_window) AS early_antibiotic_count,
  count(*) FILTER (NOT early_antibiotic_within_window) AS delayed_or_no_antibiotic_count,
  count(*) FILTER (mortality_28d) AS mortality_28d_count FROM ds GROUP BY 1, 2, 3"""


def shifted(spark, sf) -> DataFrame:
    chosen = ds.selected_predictors(datasets(spark, sf), ["gold", "model_1"])
    return ds.shift_time_zero(chosen, SHIFTS)


_SHIFT_COLUMNS = [
    "synthetic_source_predictor_name", "synthetic_shift_hours", "original_suspicion_time",
    "original_analysis_eligible", "original_analysis_exclusion_reason",
    "task_id", "predictor_name", "predictor_type", "predictor_id", "suspicion_time",
    "analysis_eligible", "analysis_exclusion_reason", "treatment_timing_category",
    "early_antibiotic_within_window", "treatment_delay_hours", "mortality_28d",
    "followup_duration_days", "hours_from_icu_to_time_zero",
]


def time_shift(spark, sf):
    out = shifted(spark, sf).select(*_SHIFT_COLUMNS)
    return with_micros(out, "original_suspicion_time", "suspicion_time")


def shift_summary(spark, sf):
    return ds.shift_summary(shifted(spark, sf))


def _shift_sql(tail: str) -> str:
    # the recomputed columns replace the ones carried from the source dataset
    derived = _derived_sql("z2", "z2 NOT BETWEEN ws AND we")
    body = SQL_DATASETS + """,
sh AS (SELECT unnest([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0, 30.5]::DOUBLE[]) AS h),
src AS (SELECT predictor_name AS sname, predictor_type AS stype, predictor_id AS sid, task_id, zero, ab, death, icu, ws, we,
  analysis_eligible AS oe, analysis_exclusion_reason AS oreason FROM ds WHERE predictor_name IN ('gold', 'model_1')),
m AS (SELECT src.*, h, zero + to_microseconds(CAST(h * 3600000000 AS BIGINT)) AS z2 FROM src CROSS JOIN sh),
moved AS (SELECT sname, stype, sid, h, zero, oe, oreason, task_id, z2, """ + derived + " FROM m)"
    return "WITH" + body + tail


_SQL_SHIFT = _shift_sql(f"""
SELECT sname AS synthetic_source_predictor_name, h AS synthetic_shift_hours, strftime(zero, '{_T}') AS original_suspicion_time,
  oe AS original_analysis_eligible, oreason AS original_analysis_exclusion_reason, task_id,
  'synthetic_' || sname || '_' || CASE WHEN h < 0 THEN 'minus' ELSE 'plus' END
    || CASE WHEN h = 30.5 THEN '30p5' ELSE CAST(CAST(abs(h) AS BIGINT) AS VARCHAR) END || 'h' AS predictor_name,
  'synthetic' AS predictor_type, sname || '|shift=' || CAST(h AS VARCHAR) AS predictor_id,
  strftime(z2, '{_T}') AS suspicion_time, analysis_eligible, analysis_exclusion_reason, treatment_timing_category,
  early_antibiotic_within_window, treatment_delay_hours, mortality_28d, followup_duration_days, hours_from_icu_to_time_zero FROM moved""")

_SQL_SHIFT_SUMMARY = _shift_sql("""
SELECT sname AS source_predictor_name, stype AS source_predictor_type, sid AS source_predictor_id, h AS shift_hours,
  count(*) AS row_count, count(*) FILTER (analysis_eligible) AS analysis_eligible_count,
  count(*) FILTER (analysis_exclusion_reason = 'missing_time_zero') AS missing_time_zero_count,
  count(*) FILTER (analysis_exclusion_reason LIKE '%shifted_time_zero_outside_study_window%') AS shifted_outside_window_count,
  count(*) FILTER (treatment_before_time_zero) AS treatment_before_time_zero_count,
  count(*) FILTER (death_before_time_zero) AS death_before_time_zero_count,
  count(*) FILTER (early_antibiotic_within_window) AS early_antibiotic_count,
  count(*) FILTER (mortality_28d) AS mortality_28d_count FROM moved GROUP BY 1, 2, 3, 4""")


# -------------------------------------------------------------------------- small ones


def shift_labels(spark, sf):
    """Names of the signed shifts that the line quantities span."""
    hours = (F.col("l_quantity") - 25) / 4
    shifts = table(spark, sf, "lineitem").select(hours.alias("shift_hours")).distinct()
    return shifts.where("shift_hours <> 0").withColumn("label", shift_label(F.col("shift_hours")))


_SQL_SHIFT_LABELS = """SELECT DISTINCT (l_quantity - 25) / 4 AS shift_hours,
  CASE WHEN l_quantity < 25 THEN 'minus' ELSE 'plus' END ||
  CASE WHEN abs((l_quantity - 25) / 4) = floor(abs((l_quantity - 25) / 4))
    THEN CAST(CAST(abs((l_quantity - 25) / 4) AS BIGINT) AS VARCHAR)
    ELSE replace(CAST(abs((l_quantity - 25) / 4) AS VARCHAR), '.', 'p') END || 'h' AS label
FROM lineitem WHERE l_quantity <> 25"""


def death_time(spark, sf):
    """Earlier of an exact and a date-only time; the date counts as its midnight."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    exact = F.when(F.col("l_returnflag") != "A", add_hours(F.col("l_shipdate"), 10))
    dated = F.when(F.col("o_orderstatus") != "P", add_hours(F.col("o_orderdate"), 24 * 365))
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    died = earliest(exact, dated)
    out = both.select("l_orderkey", "l_linenumber", died.alias("death_time"))
    return out.groupBy("l_orderkey").agg(
        F.min("death_time").alias("death_time")
    ).select(
        "l_orderkey", time_text(F.col("death_time")).alias("death_time"),
        F.year("death_time").alias("calendar_year"), F.month("death_time").alias("calendar_month"),
    )


_SQL_DEATH = """SELECT l_orderkey, strftime(d, '%Y-%m-%d %H:%M:%S') AS death_time,
  CAST(extract(year FROM d) AS INTEGER) AS calendar_year, CAST(extract(month FROM d) AS INTEGER) AS calendar_month
FROM (SELECT l_orderkey, min(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE coalesce(a, b) END) AS d
  FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'A' THEN l_shipdate + INTERVAL 10 HOUR END AS a,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 365 DAY END AS b
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1)"""


def safe_typing(spark, sf):
    """Customers and orders as raw text, typed once; absent columns and tables become NULLs."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("subject_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "n/a")
        .otherwise(F.col("o_orderkey").cast("string")).alias("hadm_id"),
        F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("admittime"),
        F.when(F.col("o_orderstatus") == "F", " x ").otherwise(F.col("o_totalprice").cast("string")).alias("valuenum"),
        F.concat(F.lit("  "), F.regexp_replace("o_orderpriority", "5-LOW", " "), F.lit(" ")).alias("priority"),
    )
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("subject_id"), F.col("c_mktsegment").alias("ethnicity")
    )
    typed_orders = typed(
        orders, {"subject_id": "bigint", "hadm_id": "bigint", "admittime": "timestamp_ntz", "valuenum": "double"}
    )
    persons = people.select(
        F.col("subject_id").try_cast("bigint").alias("subject_id"),
        optional_column(people, ("race", "ethnicity")).alias("race"),
        optional_column(people, "dod", "timestamp_ntz").alias("dod"),
    )
    vitals = empty_table(spark, "subject_id bigint, first_fever_time timestamp_ntz")
    return (
        typed_orders.join(persons, "subject_id", "left")
        .join(vitals, "subject_id", "left")
        .select(
            "subject_id", "hadm_id", time_text(F.col("admittime")).alias("admittime"),
            F.round("valuenum", 6).alias("valuenum"),
            F.upper(blank_to_null(F.col("priority"))).alias("priority"),
            "race", micros("dod").alias("dod"), micros("first_fever_time").alias("first_fever_time"),
        )
    )


_SQL_TYPING = """SELECT o_custkey AS subject_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END AS hadm_id,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS admittime,
  CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice, 6) END AS valuenum,
  CASE WHEN o_orderpriority <> '5-LOW' THEN upper(trim(o_orderpriority)) END AS priority,
  c_mktsegment AS race, CAST(NULL AS VARCHAR) AS dod, CAST(NULL AS VARCHAR) AS first_fever_time
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""

QUERIES = {
    "treatment_outcome": Bound(treatment_outcome, _SQL_OUTCOME),
    "dataset_summary": Bound(dataset_summary, _SQL_DATASET_SUMMARY),
    "time_shift": Bound(time_shift, _SQL_SHIFT),
    "shift_summary": Bound(shift_summary, _SQL_SHIFT_SUMMARY),
    "shift_labels": Bound(shift_labels, _SQL_SHIFT_LABELS),
    "death_time": Bound(death_time, _SQL_DEATH),
    "safe_typing": Bound(safe_typing, _SQL_TYPING),
}
