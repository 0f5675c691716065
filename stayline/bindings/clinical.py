"""The study's own stages over the given tables in the raw clinical layout.

Every user is a subject with one stay; an event is charted under several items, orders are
earlier admissions and their parts' brands the codes.  The stages are the library's; only
this renaming and the SQL are written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayline.bindings import Bound, rounded, table, with_micros
from stayline.bindings.timelines import sql_users, user_cohort
from stayline.functions.times import add_hours
from stayline.operators.datasets import DATASET_COLUMNS
from stayline.plans import effects, fixed_values as fv, study
from stayline.session import cut_lineage

_T = "%Y-%m-%d %H:%M:%S.%f"


def _items(*entries) -> Column:
    """Rows (itemid, valuenum); entries whose condition fails are left out."""
    rows = [F.when(held, F.struct(F.lit(item).cast("bigint").alias("itemid"), value.alias("valuenum"))) for item, value, held in entries]
    return F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull()))


def raw_layout(spark, sf) -> study.Tables:
    e = table(spark, sf, "events")
    user, kind, v, n = F.col("user_id"), F.col("event_type"), F.col("value"), F.col("event_id")
    ids = [user.alias(c) for c in ("subject_id", "hadm_id", "stay_id")]
    stored = F.when(n % 3 != 0, F.col("ts") + F.make_dt_interval(hours=(n % 5).cast("int"))).alias("storetime")
    charttime, every = F.col("ts").alias("charttime"), F.lit(True)
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.col("n_nationkey")
    own = {0: (220045, "Heart Rate"), 1: (220179, "Non Invasive Blood Pressure systolic"), 2: (223761, "Temperature Fahrenheit"),
           3: (223762, "Temperature Celsius"), 4: (220052, "Arterial Blood Pressure mean")}
    item, label = key.cast("bigint"), F.when(F.col("n_regionkey") == 0, "Intubation").when(F.col("n_regionkey") == 1, " Invasive Ventilation ").otherwise(F.col("n_name"))
    for at, (number, name) in own.items():
        item, label = F.when(key == at, F.lit(number).cast("bigint")).otherwise(item), F.when(key == at, name).otherwise(label)
    lab = F.col("r_regionkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("admittime"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace("p_brand", "^Brand#", "a.").alias("icd_code"), F.col("p_name").alias("long_title"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), "l_partkey", F.col("l_linenumber").alias("seq_num"))
    return {
        "chartevents": e.select(*ids, charttime, stored, _items(
            (220045, v, every), (220179, v * 2, every), (223761, 90 + v / 20, every), (223762, v / 3, kind == "click"), (225792, v, (kind == "error") & (v > 50)))),
        "labevents": e.select(*ids, charttime, stored, _items((51516, v, every), (50813, v / 4, every), (50912, v / 8, every))),
        "inputevents": e.where((kind == "purchase") & (n % 4 == 0)).select(ids[2], F.col("ts").alias("starttime"), F.lit(221906).cast("bigint").alias("itemid")),
        "procedureevents": e.where(kind == "click").select(ids[2], F.col("ts").alias("starttime"), (n % 25).alias("itemid")),
        "transfers": e.where(kind.isin("signup", "error")).select(
            *ids[:2], n.alias("transfer_id"), F.when(kind == "signup", F.col("props")).otherwise(" ").alias("careunit"), F.col("ts").alias("intime")),
        "emar": e.where(kind == "purchase").select(
            *ids[:2], charttime, F.lit("Administered").alias("event_txt"), F.when(n % 2 == 0, "Vancomycin").otherwise("Saline").alias("medication")),
        "microbiologyevents": e.where(kind == "click").select(
            *ids[:2], F.when(n % 7 != 0, F.col("ts")).alias("charttime"), F.col("ts").alias("chartdate"),
            F.when(n % 3 == 0, "BLOOD CULTURE").when(n % 3 == 1, "URINE").otherwise("Swab").alias("spec_type_desc"), F.lit("culture").alias("test_name")),
        "d_items": nation.select(item.alias("itemid"), label.alias("label")),
        "d_labitems": region.select(
            F.when(lab == 0, 50813).when(lab == 1, 51516).otherwise(lab).cast("bigint").alias("itemid"),
            F.when(lab == 0, "Lactate").when(lab == 1, "White Blood Cells").otherwise(F.col("r_name")).alias("label")),
        "admissions": orders,
        "diagnoses_icd": lines.join(part, "l_partkey").join(orders.drop("admittime"), "hadm_id").select(
            "subject_id", "hadm_id", "seq_num", "icd_code", F.lit("10").alias("icd_version")),
        "d_icd_diagnoses": part.select("icd_code", F.lit("10").alias("icd_version"), "long_title").distinct(),
    }


def bought(spark, sf) -> DataFrame:
    """One analysis row per purchase, with the subject's fixed attributes."""
    e = table(spark, sf, "events").where(F.col("event_type") == "purchase")
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), (F.col("c_nationkey") + 20).alias("anchor_age"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"), F.concat(F.lit(" "), "c_mktsegment").alias("admission_type"))
    user, ts = F.col("user_id"), F.col("ts")
    return e.select(
        F.concat(F.lit("task-"), F.col("event_id").cast("string")).alias("task_id"), user.alias("subject_id"), user.alias("hadm_id"),
        user.alias("stay_id"), "event_id", "value", ts.alias("suspicion_time"), add_hours(ts, -72).alias("study_window_start"),
        add_hours(ts, -24 * 9000).alias("admittime"),
    ).join(people, "subject_id")


def study_covariates(spark, sf):
    """The 16 covariates of every purchase."""
    out = study.covariates(bought(spark, sf), raw_layout(spark, sf)).select("task_id", *fv.COVARIATES)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


_SQL_COVARIATES = """WITH r AS (SELECT 'task-' || event_id AS task_id, user_id, ts AS t0, ts - INTERVAL 72 HOUR AS ws, ts - INTERVAL 9000 DAY AS adm
  FROM events WHERE event_type = 'purchase'),
seen AS (SELECT task_id, e.*, CASE WHEN event_id % 3 <> 0 THEN ts + to_hours(CAST(event_id % 5 AS INTEGER)) END AS st
  FROM r JOIN events e ON e.user_id = r.user_id AND ts >= ws AND ts < t0),
m AS (SELECT task_id, unnest([
    {'name': 'hr', 'v': CASE WHEN value BETWEEN 20 AND 250 THEN value END},
    {'name': 'sbp', 'v': CASE WHEN value * 2 BETWEEN 30 AND 300 THEN value * 2 END},
    {'name': 'temp', 'v': CASE WHEN (90 + value / 20 - 32.0) * (5.0::DOUBLE / 9.0) BETWEEN 25 AND 45 THEN (90 + value / 20 - 32.0) * (5.0::DOUBLE / 9.0) END},
    {'name': 'temp', 'v': CASE WHEN event_type = 'click' AND value / 3 BETWEEN 25 AND 45 THEN value / 3 END},
    {'name': 'wbc', 'v': CASE WHEN value BETWEEN 0 AND 500 THEN value END},
    {'name': 'lac', 'v': CASE WHEN value / 4 BETWEEN 0 AND 50 THEN value / 4 END},
    {'name': 'cre', 'v': CASE WHEN value / 8 BETWEEN 0 AND 30 THEN value / 8 END}], recursive := true), ts, st FROM seen),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, name ORDER BY ts DESC, st DESC NULLS LAST, v DESC) AS rk FROM m WHERE v IS NOT NULL) WHERE rk = 1),
x AS (SELECT task_id, max(v) FILTER (name = 'hr') AS hr, max(v) FILTER (name = 'sbp') AS sbp, max(v) FILTER (name = 'temp') AS temp,
  max(v) FILTER (name = 'wbc') AS wbc, max(v) FILTER (name = 'lac') AS lac, max(v) FILTER (name = 'cre') AS cre FROM l GROUP BY 1),
vent AS (SELECT task_id, bool_or(event_type = 'error' AND value > 50 OR event_type = 'click' AND event_id % 25 IN (
    SELECT n_nationkey FROM nation WHERE n_nationkey > 4 AND n_regionkey IN (0, 1))) AS vent,
  bool_or(event_type = 'purchase' AND event_id % 4 = 0) AS vaso FROM seen GROUP BY 1),
unit AS (SELECT task_id, trim(props) AS unit FROM (SELECT task_id, props, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS rk
  FROM r JOIN events e ON e.user_id = r.user_id AND ts < t0 AND event_type = 'signup') WHERE rk = 1),
codes AS (SELECT o_custkey, o_orderkey, o_orderdate, nullif(regexp_extract(upper(replace(replace(p_brand, 'Brand#', 'a.'), '.', '')), '^[A-Z]?[0-9]{2,3}'), '') AS root
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
pa AS (SELECT task_id, count(DISTINCT o_orderkey) AS n FROM r JOIN orders ON o_custkey = user_id AND o_orderdate < adm GROUP BY 1),
pd AS (SELECT task_id, count(DISTINCT root) AS n FROM r JOIN codes ON o_custkey = user_id AND o_orderdate < adm GROUP BY 1)
SELECT r.task_id, CAST(c_nationkey + 20 AS DOUBLE) AS age_years, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_mktsegment AS admission_type,
  unit AS pre_t0_careunit, CAST(year(t0) AS INTEGER) AS calendar_year, CAST(month(t0) AS INTEGER) AS calendar_month,
  coalesce(pa.n, 0) AS prior_admission_count, coalesce(pd.n, 0) AS prior_diagnosis_root_count, round(hr, 6) AS pre_t0_heart_rate, round(sbp, 6) AS pre_t0_sbp,
  round(temp, 6) AS pre_t0_temperature_c, round(wbc, 6) AS pre_t0_wbc, round(lac, 6) AS pre_t0_lactate, round(cre, 6) AS pre_t0_creatinine,
  coalesce(vent, false) AS pre_t0_mechanical_ventilation, coalesce(vaso, false) AS pre_t0_vasopressor
FROM r JOIN customer ON c_custkey = user_id LEFT JOIN x USING (task_id) LEFT JOIN vent USING (task_id) LEFT JOIN unit USING (task_id)
LEFT JOIN pa USING (task_id) LEFT JOIN pd USING (task_id)"""


SIGNALS = ("fever", "hypotension", "tachycardia", "antibiotic_admin", "blood_culture_order", "lactate", "abnormal_wbc")


def study_signals(spark, sf):
    """Rule signals of every stay, vital signs by item dictionary and CASE order included."""
    cohort = user_cohort(spark, sf, 24, 240).withColumn("stay_id", F.col("subject_id"))
    found = study.rule_signals(cut_lineage(cohort), raw_layout(spark, sf), include_vitals=True)
    columns = [c for s in SIGNALS for c in (f"first_{s}_time", f"{s}_event_count")]
    source = ["first_culture_context_source", "first_culture_context_specimen", "culture_context_event_count"]
    return with_micros(found.select("stay_id", *columns, *source), *columns[::2])


_SQL_SIGNALS = "WITH" + sql_users(24, 240) + """,
h AS (SELECT subject_id AS stay_id, e.* FROM users JOIN events e ON e.user_id = subject_id AND ts BETWEEN ws AND we),
k AS (SELECT stay_id, ts, unnest([
    CASE WHEN value * 2 < 90 THEN 'hypotension' END, CASE WHEN value > 100 THEN 'tachycardia' END,
    CASE WHEN 90 + value / 20 >= 100.4 THEN 'fever' END, CASE WHEN event_type = 'click' AND value / 3 >= 38 THEN 'fever' END,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'antibiotic_admin' END,
    CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'blood_culture_order' END,
    'lactate', CASE WHEN value < 4 OR value > 12 THEN 'abnormal_wbc' END]) AS s FROM h),
c AS (SELECT stay_id, 'urinary' AS src, 'URINE' AS spec, count(*) AS n FROM h WHERE event_type = 'click' AND event_id % 3 = 1 GROUP BY 1)
SELECT u.subject_id AS stay_id, """ + ", ".join(
    f"strftime(min(k.ts) FILTER (s = '{s}'), '{_T}') AS first_{s}_time, nullif(count(*) FILTER (s = '{s}'), 0) AS {s}_event_count" for s in SIGNALS
) + """, any_value(src) AS first_culture_context_source, any_value(spec) AS first_culture_context_specimen, any_value(c.n) AS culture_context_event_count
FROM users u LEFT JOIN k ON k.stay_id = u.subject_id LEFT JOIN c ON c.stay_id = u.subject_id GROUP BY u.subject_id"""


# ------------------------------------------------------------------------ the causal stage

PREDICTORS = (("gold", "gold", 0), ("x_rule", "rule_based", 1), ("model_a", "model", 2), ("model_b", "model", 3))
ELIGIBLE_FROM = "2024-01-16"
ADMITTED = "1900-01-01"


def predicted(spark, sf) -> DataFrame:
    """Four datasets over late purchases: the rule has no treated arm, model_b's deaths are
    all in one arm, model_b's times differ on every fourth task."""
    rows = bought(spark, sf).where(F.col("suspicion_time") >= F.lit(ELIGIBLE_FROM).cast("timestamp_ntz"))
    n, late, name = F.col("event_id"), F.col("event_id") % 4 == 0, F.col("predictor_name")
    panel = spark.createDataFrame(list(PREDICTORS), "predictor_name string, predictor_type string, _no int")
    treated = ((n % 10 + F.col("_no")) % 3 == 0) & (name != "x_rule")
    died = (F.col("value") < 60) & F.when(name == "model_b", treated).otherwise(n % 7 < 5)
    full = rows.crossJoin(F.broadcast(panel)).withColumns(
        {
            "predictor_id": name,
            "suspected_sepsis": F.lit(True),
            "suspicion_time": F.when((name == "model_b") & late, add_hours(F.col("suspicion_time"), 2)).otherwise(F.col("suspicion_time")),
            "study_window_start": add_hours(F.col("suspicion_time"), -24 * 40),
            "infection_source": F.lit("lung"),
            "early_antibiotic_within_window": treated,
            "mortality_28d": died,
            "followup_duration_days": F.round(F.when(died, F.least(F.col("value") / 4 + 0.01, F.lit(27.5))).otherwise(28.0), 6),
            "analysis_eligible": n % 11 != F.col("_no"),
        }
    )
    absent = {c: F.lit(None).cast("string") for c in DATASET_COLUMNS if c not in full.columns}
    return full.withColumns(absent).select(*DATASET_COLUMNS)


def admitted(spark, sf) -> DataFrame:
    """Every subject's admission, the transfer that a stay begins with, before all its events.

    The causal stage asks for a care unit before every eligible time zero, and some users buy
    before their first signup; for all others a later unit is the latest one.
    """
    subject = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        subject.alias("subject_id"), subject.alias("hadm_id"), F.lit(-1).cast("bigint").alias("transfer_id"),
        F.lit("Admission").alias("careunit"), F.lit(ADMITTED).cast("timestamp_ntz").alias("intime"))


def causal_statuses(spark, sf):
    """Every dataset and scope with its counts and status; failed ones are rows, too."""
    raw = raw_layout(spark, sf)
    raw["transfers"] = raw["transfers"].unionByName(admitted(spark, sf))
    try:
        results = effects.causal_stage(cut_lineage(predicted(spark, sf)), raw)
    except effects.EstimationFailed as failed:
        results = failed.results
    status = F.regexp_replace("convergence_status", "^failed:[a-z]+: .*", "failed:hazard model")
    return results["summary"].select(
        "dataset_name", "dataset_type", "analysis_scope", "input_row_count", "analysis_row_count", "excluded_row_count",
        "treated_count", "control_count", "event_count", status.alias("convergence_status"),
        F.col("primary_hr").isNotNull().alias("has_estimate"),
    )


_SQL_STATUS = f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in PREDICTORS)}) t(name, kind, no)),
d AS (SELECT *, CASE WHEN name = 'model_b' THEN value < 60 AND treated ELSE value < 60 AND event_id % 7 < 5 END AS died FROM (
  SELECT p.*, event_id, value, event_id % 11 <> no AS fit, (event_id % 10 + no) % 3 = 0 AND name <> 'x_rule' AS treated
  FROM events JOIN customer ON c_custkey = user_id, p WHERE event_type = 'purchase' AND ts >= TIMESTAMP '{ELIGIBLE_FROM}')),
s AS (SELECT 'full_cohort' AS scope, * FROM d UNION ALL SELECT 'disagreement_subset', * FROM d WHERE event_id % 4 = 0),
c AS (SELECT name, kind, scope, count(*) AS n, count(*) FILTER (fit) AS m, count(*) FILTER (fit AND treated) AS t, count(*) FILTER (fit AND NOT treated) AS k,
  count(*) FILTER (fit AND died) AS e, count(*) FILTER (fit AND died AND treated) AS et, count(*) FILTER (fit AND died AND NOT treated) AS ek FROM s GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN m = 0 THEN 'failed:no_eligible_rows' WHEN t = 0 OR k = 0 THEN 'failed:one_treatment_arm' WHEN e = 0 OR e = m THEN 'failed:one_outcome'
  WHEN et = 0 OR ek = 0 THEN 'failed:hazard model' ELSE 'ok' END AS status FROM c)
SELECT name AS dataset_name, kind AS dataset_type, scope AS analysis_scope, n AS input_row_count, CASE WHEN status = 'ok' THEN m ELSE 0 END AS analysis_row_count,
  CASE WHEN status = 'ok' THEN n - m ELSE n END AS excluded_row_count, CASE WHEN status IN ('ok', 'failed:hazard model') THEN t ELSE 0 END AS treated_count,
  CASE WHEN status IN ('ok', 'failed:hazard model') THEN k ELSE 0 END AS control_count, CASE WHEN status IN ('ok', 'failed:hazard model') THEN e ELSE 0 END AS event_count,
  status AS convergence_status, status = 'ok' AS has_estimate FROM v"""

QUERIES = {
    "study_covariates": Bound(study_covariates, _SQL_COVARIATES),
    "study_signals": Bound(study_signals, _SQL_SIGNALS),
    "causal_statuses": Bound(causal_statuses, _SQL_STATUS),
}
