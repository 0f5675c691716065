"""Event-stream bindings: classified signals, as-of covariates, history and tiered rules.

Users are subjects; a user's first signup opens the study window.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from stayline.bindings import Bound, micros, rounded, table, with_micros
from stayline.functions.lists import joined
from stayline.functions.text import code_root
from stayline.functions.times import add_hours, study_window
from stayline.functions.typing import blank_to_null
from stayline.operators import asof, cohort as co, rules, signals as sg

_T = "%Y-%m-%d %H:%M:%S.%f"


def user_cohort(spark, sf, hours_before: float, hours_after: float) -> DataFrame:
    signups = table(spark, sf, "events").where(F.col("event_type") == "signup")
    first = co.first_per_key(signups.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])
    start, end = study_window(F.col("ts"), hours_before, hours_after)
    return first.select(
        F.col("user_id").alias("subject_id"),
        F.col("user_id").alias("hadm_id"),
        F.col("event_id").alias("stay_id"),
        F.col("ts").alias("icu_intime"),
        start.alias("study_window_start"),
        end.alias("study_window_end"),
    )


def user_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumnRenamed("user_id", "subject_id")


def sql_users(before: int, after: int) -> str:
    return f"""
users AS (
  SELECT user_id AS subject_id, event_id AS stay_id, ts AS icu_intime,
    ts - INTERVAL {before} HOUR AS ws, ts + INTERVAL {after} HOUR AS we
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rk
        FROM events WHERE event_type = 'signup') WHERE rk = 1)"""


# ------------------------------------------------------------------ classified signals

KIND = (
    "CASE WHEN event_type = 'view' AND value >= 38.0 THEN 'fever' "
    "WHEN event_type = 'click' AND value >= 100.4 THEN 'fever' "
    "WHEN event_type = 'error' AND value < 6.5 THEN 'hypotension' "
    "WHEN event_type = 'purchase' AND value < 9.0 THEN 'hypotension' "
    "WHEN event_type = 'signup' AND value > 100.0 THEN 'tachycardia' END"
)


def event_classifier(spark, sf):
    cohort = user_cohort(spark, sf, 24, 240)
    of = {"view": 38.0, "click": 100.4}
    kind = F.col("event_type")
    v = F.col("value")
    support = (
        F.when((kind == "view") & (v >= of["view"]), "fever")
        .when((kind == "click") & (v >= of["click"]), "fever")
        .when((kind == "error") & (v < 6.5), "hypotension")
        .when((kind == "purchase") & (v < 9.0), "hypotension")
        .when((kind == "signup") & (v > 100.0), "tachycardia")
    )
    events = user_events(spark, sf).select("subject_id", "ts", support.alias("support_type"))
    names = ("fever", "hypotension", "tachycardia")
    found = sg.windowed_signals(
        cohort, events, ["subject_id"], "ts", {n: F.col("support_type") == n for n in names}
    )
    return with_micros(found, *[f"first_{n}_time" for n in names])


_SQL_CLASSIFIER = "WITH" + sql_users(24, 240) + f""",
hits AS (SELECT stay_id, ts, {KIND} AS kind FROM users JOIN events ON user_id = subject_id
  WHERE ts BETWEEN ws AND we)
SELECT stay_id,
  strftime(min(ts) FILTER (kind = 'fever'), '{_T}') AS first_fever_time,
  nullif(count(*) FILTER (kind = 'fever'), 0) AS fever_event_count,
  strftime(min(ts) FILTER (kind = 'hypotension'), '{_T}') AS first_hypotension_time,
  nullif(count(*) FILTER (kind = 'hypotension'), 0) AS hypotension_event_count,
  strftime(min(ts) FILTER (kind = 'tachycardia'), '{_T}') AS first_tachycardia_time,
  nullif(count(*) FILTER (kind = 'tachycardia'), 0) AS tachycardia_event_count
FROM hits WHERE kind IS NOT NULL GROUP BY stay_id"""


# ------------------------------------------------------------------------ as-of lookups


def purchase_rows(spark, sf) -> DataFrame:
    """One analysis row per purchase; the purchase is time zero, the 72 h before it the window."""
    bought = user_events(spark, sf).where(F.col("event_type") == "purchase")
    return bought.select(
        F.concat(F.lit("task-"), F.col("event_id").cast("string")).alias("task_id"),
        "subject_id",
        F.col("ts").alias("time_zero"),
        add_hours(F.col("ts"), -72).alias("study_window_start"),
        add_hours(F.col("ts"), -24 * 9000).alias("admittime"),
    )


def as_of_measures():
    kind, v = F.col("event_type"), F.col("value")
    celsius = (v - 32.0) * (5.0 / 9.0)
    warm = F.when(kind == "click", celsius).otherwise(v)
    return {
        "pre_t0_view": ((kind == "view") & v.between(1, 200), v),
        "pre_t0_temperature": (kind.isin("click", "signup") & warm.between(-10, 45), warm),
    }


def lookups(spark, sf, rows):
    found = asof.latest_before(
        rows, user_events(spark, sf), ["subject_id"], "ts", order=["event_id"],
        values=as_of_measures(),
        flags={"pre_t0_error": (F.col("event_type") == "error") & (F.col("value") > 50)},
    )
    return asof.attach_latest(rows, found, ["subject_id"], flags=["pre_t0_error"])


def asof_latest(spark, sf):
    rows = lookups(spark, sf, purchase_rows(spark, sf))
    out = rows.select("task_id", "time_zero", "pre_t0_view", "pre_t0_temperature")
    return rounded(with_micros(out, "time_zero"), "pre_t0_view", "pre_t0_temperature")


_SQL_ROWS = """
rows AS (SELECT 'task-' || event_id AS task_id, user_id AS subject_id, ts AS time_zero,
  ts - INTERVAL 72 HOUR AS ws, ts - INTERVAL 9000 DAY AS admittime
  FROM events WHERE event_type = 'purchase'),
seen AS (SELECT task_id, e.*, CASE WHEN event_type = 'click' THEN (value - 32.0) * (5.0 / 9.0) ELSE value END AS warm
  FROM rows r JOIN events e ON e.user_id = r.subject_id AND e.ts >= r.ws AND e.ts < r.time_zero),
lv AS (SELECT task_id, value AS pre_t0_view FROM (SELECT *, row_number() OVER (PARTITION BY task_id
  ORDER BY ts DESC, event_id DESC NULLS LAST) rk FROM seen WHERE event_type = 'view' AND value BETWEEN 1 AND 200) WHERE rk = 1),
lt AS (SELECT task_id, warm AS pre_t0_temperature FROM (SELECT *, row_number() OVER (PARTITION BY task_id
  ORDER BY ts DESC, event_id DESC NULLS LAST) rk FROM seen WHERE event_type IN ('click', 'signup') AND warm BETWEEN -10 AND 45) WHERE rk = 1)"""

_SQL_ASOF = "WITH" + _SQL_ROWS + f"""
SELECT r.task_id, strftime(time_zero, '{_T}') AS time_zero, round(pre_t0_view, 6) AS pre_t0_view,
  round(pre_t0_temperature, 6) AS pre_t0_temperature
FROM rows r LEFT JOIN lv ON lv.task_id = r.task_id LEFT JOIN lt ON lt.task_id = r.task_id"""


def exposure_flags(spark, sf):
    """Two sources may set the flag; each is one semi-join-like lookup without fan-out."""
    rows = purchase_rows(spark, sf)
    lines = user_events(spark, sf)
    either = asof.latest_before(
        rows, lines, ["subject_id"], "ts",
        flags={
            "pre_t0_ventilation": ((F.col("event_type") == "error") & (F.col("value") > 50))
            | ((F.col("event_type") == "view") & (F.col("value") > 100)),
            "pre_t0_vasopressor": (F.col("event_type") == "click") & (F.col("value") > 120),
        },
    )
    flags = ["pre_t0_ventilation", "pre_t0_vasopressor"]
    return asof.attach_latest(rows, either, ["subject_id"], flags=flags).select("task_id", *flags)


_SQL_FLAGS = """WITH rows AS (SELECT 'task-' || event_id AS task_id, user_id, ts AS t0, ts - INTERVAL 72 HOUR AS ws
  FROM events WHERE event_type = 'purchase')
SELECT task_id,
  EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.ts >= ws AND e.ts < t0
     AND event_type = 'error' AND value > 50)
  OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.ts >= ws AND e.ts < t0
     AND event_type = 'view' AND value > 100) AS pre_t0_ventilation,
  EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.ts >= ws AND e.ts < t0
     AND event_type = 'click' AND value > 120) AS pre_t0_vasopressor
FROM rows r"""


# ------------------------------------------------------------------------ prior history


def order_codes(spark, sf) -> DataFrame:
    """Part brands as diagnosis codes of an order, with the order's time."""
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    code = F.regexp_replace("p_brand", "^Brand#", "a.")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .join(orders, F.col("l_orderkey") == orders.o_orderkey)
        .select(
            F.col("o_custkey").alias("subject_id"),
            code_root(code).alias("root"),
            F.col("o_orderdate").alias("admittime"),
        )
    )


HISTORY = ("prior_admission_count", "prior_diagnosis_root_count")


def history(spark, sf, rows) -> DataFrame:
    admissions = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
    )
    return asof.prior_distinct_counts(
        rows,
        {
            HISTORY[0]: (admissions, "hadm_id", "admittime"),
            HISTORY[1]: (order_codes(spark, sf), "root", "admittime"),
        },
        "subject_id", "admittime",
    )


def prior_history(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("admittime"),
    )
    out = asof.attach_counts(rows, history(spark, sf, rows), "subject_id", "admittime", HISTORY)
    return out.select("task_id", *HISTORY)


_SQL_CODES = """
codes AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
  nullif(regexp_extract(upper(replace(replace(p_brand, 'Brand#', 'a.'), '.', '')), '^[A-Z]?[0-9]{2,3}'), '') AS root
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

_SQL_HISTORY = "WITH" + _SQL_CODES + """,
pa AS (SELECT r.o_orderkey AS task_id, count(DISTINCT p.o_orderkey) AS n FROM orders r
  LEFT JOIN orders p ON p.o_custkey = r.o_custkey AND p.o_orderdate < r.o_orderdate GROUP BY 1),
pd AS (SELECT r.o_orderkey AS task_id, count(DISTINCT c.root) AS n FROM orders r
  LEFT JOIN codes c ON c.subject_id = r.o_custkey AND c.admittime < r.o_orderdate GROUP BY 1)
SELECT pa.task_id, pa.n AS prior_admission_count, pd.n AS prior_diagnosis_root_count
FROM pa JOIN pd ON pa.task_id = pd.task_id"""


# ------------------------------------------------------------------- covariate matrix


def covariate_matrix(spark, sf):
    rows = purchase_rows(spark, sf)
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        (F.col("c_nationkey") + 20).cast("double").alias("age_years"),
        blank_to_null(F.col("c_mktsegment")).alias("admission_type"),
    )
    units = asof.latest_before(
        rows, asof.reduce_to_keys(user_events(spark, sf), asof.key_table(rows, ["subject_id"]), ["subject_id"]),
        ["subject_id"], "ts", start=None, order=["event_id"],
        values={"pre_t0_careunit": (F.col("event_type") == "signup", F.col("props"))},
    )
    matrix = asof.attach_latest(lookups(spark, sf, rows), units, ["subject_id"], start=None)
    matrix = asof.attach_counts(
        matrix.join(people, "subject_id", "left"), history(spark, sf, rows), "subject_id", "admittime", HISTORY
    )
    matrix = matrix.select(
        "task_id", "age_years", "admission_type", "pre_t0_careunit",
        F.year("time_zero").alias("calendar_year"), F.month("time_zero").alias("calendar_month"),
        "prior_admission_count", "prior_diagnosis_root_count",
        "pre_t0_view", "pre_t0_temperature", "pre_t0_error",
    )
    return rounded(matrix, "pre_t0_view", "pre_t0_temperature")


_SQL_MATRIX = "WITH" + _SQL_ROWS + "," + _SQL_CODES + """,
unit AS (SELECT task_id, props AS pre_t0_careunit FROM (
  SELECT r.task_id, e.props, row_number() OVER (PARTITION BY r.task_id ORDER BY e.ts DESC, e.event_id DESC) rk
  FROM rows r JOIN events e ON e.user_id = r.subject_id AND e.ts < r.time_zero AND e.event_type = 'signup') WHERE rk = 1),
pa AS (SELECT r.task_id, count(DISTINCT o_orderkey) n FROM rows r LEFT JOIN orders
  ON o_custkey = r.subject_id AND o_orderdate < r.admittime GROUP BY 1),
pd AS (SELECT r.task_id, count(DISTINCT c.root) n FROM rows r LEFT JOIN codes c
  ON c.subject_id = r.subject_id AND c.admittime < r.admittime GROUP BY 1),
err AS (SELECT DISTINCT task_id FROM seen WHERE event_type = 'error' AND value > 50)
SELECT r.task_id, CAST(c_nationkey + 20 AS DOUBLE) AS age_years, nullif(trim(c_mktsegment), '') AS admission_type,
  pre_t0_careunit, CAST(extract(year FROM time_zero) AS INTEGER) AS calendar_year,
  CAST(extract(month FROM time_zero) AS INTEGER) AS calendar_month,
  pa.n AS prior_admission_count, pd.n AS prior_diagnosis_root_count,
  round(pre_t0_view, 6) AS pre_t0_view, round(pre_t0_temperature, 6) AS pre_t0_temperature,
  err.task_id IS NOT NULL AS pre_t0_error
FROM rows r LEFT JOIN customer ON c_custkey = r.subject_id
LEFT JOIN unit ON unit.task_id = r.task_id LEFT JOIN pa ON pa.task_id = r.task_id
LEFT JOIN pd ON pd.task_id = r.task_id LEFT JOIN lv ON lv.task_id = r.task_id
LEFT JOIN lt ON lt.task_id = r.task_id LEFT JOIN err ON err.task_id = r.task_id"""


# ------------------------------------------------------------------------- tiered rule

TIER1 = ("tier1_note_evidence", "first_note_evidence_time")
TIER2 = (
    ("tier2_antibiotic_administration", "first_antibiotic_admin_time"),
    ("tier2_blood_culture_order", "first_blood_culture_order_time"),
)
TIER3 = (("tier3_lactate", "first_lactate_time"), ("tier3_abnormal_wbc", "first_abnormal_wbc_time"))


def rule_signals(spark, sf) -> DataFrame:
    cohort = user_cohort(spark, sf, 24, 96)
    events = user_events(spark, sf)
    kind, v = F.col("event_type"), F.col("value")
    described = events.withColumns(
        {
            "phrase": F.when(v > 120, "sepsis").otherwise("suspected infection"),
            "note_source": F.when(v > 90, "pulmonary"),
            "note_id": F.col("event_id").cast("string"),
            "culture_source": F.when(v > 100, "urinary").otherwise("abdominal"),
        }
    )
    found = sg.windowed_signals(
        cohort, described, ["subject_id"], "ts",
        {
            "antibiotic_admin": (kind == "purchase") & (v > 80),
            "blood_culture_order": (kind == "click") & (v > 80),
            "lactate": (kind == "view") & (v > 60),
            "abnormal_wbc": (kind == "signup") & ((v < 4) | (v > 120)),
        },
        [
            sg.FirstMatch(
                (kind == "error") & (v > 60), ["note_id"],
                {
                    "first_note_evidence_id": "note_id",
                    "first_note_match_phrase": "phrase",
                    "first_note_source": "note_source",
                },
                "first_note_evidence_time", "note_evidence_count",
            ),
            sg.FirstMatch(
                (kind == "click") & (v > 50), ["event_id"],
                {"first_culture_context_source": "culture_source"},
                "first_culture_context_time", "culture_context_event_count",
            ),
        ],
    )
    segment = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "skin_soft_tissue")
        .when(F.col("c_mktsegment") == "MACHINERY", "line_device")
        .alias("first_diagnosis_source"),
    )
    return co.attach_signals(cohort, [found]).join(segment, "subject_id", "left")


EVIDENCE = (
    ("first_note_evidence_time", ("notes:note_charttime", "notes:text")),
    ("first_note_evidence_id", ("notes:note_id",)),
    ("first_antibiotic_admin_time", ("emar:charttime", "emar:medication")),
    ("first_blood_culture_order_time", ("microbiologyevents:charttime",)),
    ("first_lactate_time", ("labevents:charttime", "labevents:itemid")),
    ("first_abnormal_wbc_time", ("labevents:charttime", "labevents:valuenum")),
    ("first_diagnosis_source", ("diagnoses_icd:seq_num",)),
)


def rule_labels(spark, sf) -> DataFrame:
    return rules.tiered_label(
        rule_signals(spark, sf),
        tier1=TIER1, tier2=TIER2, tier3=TIER3,
        sources=(
            ("note_text", "first_note_source"),
            ("culture_context", "first_culture_context_source"),
            ("diagnosis_fallback", "first_diagnosis_source"),
        ),
        evidence=EVIDENCE,
    )


def tiered_rule(spark, sf):
    return rule_labels(spark, sf).select(
        "stay_id", "subject_id", micros("suspicion_time_rule").alias("suspicion_time_rule"),
        "suspicion_time_rule_source", "rule_confidence", "infection_source_rule",
        "infection_source_rule_source", joined(F.col("rule_trigger")).alias("rule_trigger"),
        joined(F.col("evidence_source")).alias("evidence_source"), "rule_no_fire_reason",
        "first_note_evidence_id", "first_note_match_phrase",
    )


def rule_summary(spark, sf):
    return rules.rule_summary(rule_labels(spark, sf), [n for n, _ in (TIER1, *TIER2, *TIER3)])


def rule_category_counts(spark, sf):
    return rules.category_counts(
        rule_labels(spark, sf),
        ["suspicion_time_rule_source", "rule_confidence", "infection_source_rule"],
    )


SQL_RULE = sql_users(24, 96) + """,
hits AS (SELECT u.stay_id, e.* FROM users u JOIN events e ON e.user_id = u.subject_id WHERE e.ts BETWEEN ws AND we),
note AS (SELECT * FROM (SELECT stay_id, ts AS note_t, CAST(event_id AS VARCHAR) AS note_id,
    CASE WHEN value > 120 THEN 'sepsis' ELSE 'suspected infection' END AS phrase,
    CASE WHEN value > 90 THEN 'pulmonary' END AS note_src,
    row_number() OVER (PARTITION BY stay_id ORDER BY ts, CAST(event_id AS VARCHAR)) rk
  FROM hits WHERE event_type = 'error' AND value > 60) WHERE rk = 1),
cul AS (SELECT * FROM (SELECT stay_id, CASE WHEN value > 100 THEN 'urinary' ELSE 'abdominal' END AS cul_src,
    row_number() OVER (PARTITION BY stay_id ORDER BY ts, event_id) rk
  FROM hits WHERE event_type = 'click' AND value > 50) WHERE rk = 1),
sig AS (SELECT stay_id, min(ts) FILTER (event_type = 'purchase' AND value > 80) AS ab_t,
    min(ts) FILTER (event_type = 'click' AND value > 80) AS bc_t,
    min(ts) FILTER (event_type = 'view' AND value > 60) AS la_t,
    min(ts) FILTER (event_type = 'signup' AND (value < 4 OR value > 120)) AS wb_t FROM hits GROUP BY 1),
base AS (SELECT u.subject_id, u.stay_id, note_t, note_id, phrase, note_src, cul_src, ab_t, bc_t, la_t, wb_t,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'skin_soft_tissue' WHEN c_mktsegment = 'MACHINERY' THEN 'line_device' END AS dx_src,
    coalesce(note_t, least(ab_t, bc_t)) AS fired
  FROM users u LEFT JOIN note USING (stay_id) LEFT JOIN cul USING (stay_id) LEFT JOIN sig USING (stay_id)
  LEFT JOIN customer ON c_custkey = u.subject_id),
labels AS (SELECT *,
  CASE WHEN note_t IS NOT NULL THEN 'tier1_note_evidence'
       WHEN ab_t IS NOT NULL AND (bc_t IS NULL OR ab_t <= bc_t) THEN 'tier2_antibiotic_administration'
       WHEN bc_t IS NOT NULL THEN 'tier2_blood_culture_order' END AS fired_by,
  CASE WHEN note_t IS NOT NULL AND least(abs(epoch_us(ab_t) - epoch_us(note_t)), abs(epoch_us(bc_t) - epoch_us(note_t))) <= 6 * 3600000000 THEN 'high'
       WHEN fired IS NOT NULL THEN 'medium' ELSE 'low' END AS conf,
  CASE WHEN fired IS NOT NULL THEN coalesce(note_src, cul_src, dx_src) END AS src,
  CASE WHEN fired IS NULL THEN NULL WHEN note_src IS NOT NULL THEN 'note_text' WHEN cul_src IS NOT NULL THEN 'culture_context'
       WHEN dx_src IS NOT NULL THEN 'diagnosis_fallback' END AS src_by,
  nullif(concat_ws('|', CASE WHEN note_t IS NOT NULL THEN 'tier1_note_evidence' END,
    CASE WHEN ab_t IS NOT NULL THEN 'tier2_antibiotic_administration' END,
    CASE WHEN bc_t IS NOT NULL THEN 'tier2_blood_culture_order' END,
    CASE WHEN la_t IS NOT NULL THEN 'tier3_lactate' END, CASE WHEN wb_t IS NOT NULL THEN 'tier3_abnormal_wbc' END), '') AS trig,
  nullif(concat_ws('|', CASE WHEN note_t IS NOT NULL THEN 'notes:note_charttime|notes:text|notes:note_id' END,
    CASE WHEN ab_t IS NOT NULL THEN 'emar:charttime|emar:medication' END,
    CASE WHEN bc_t IS NOT NULL THEN 'microbiologyevents:charttime' END,
    CASE WHEN la_t IS NOT NULL THEN 'labevents:charttime|labevents:itemid' END,
    CASE WHEN wb_t IS NOT NULL AND la_t IS NOT NULL THEN 'labevents:valuenum'
         WHEN wb_t IS NOT NULL THEN 'labevents:charttime|labevents:valuenum' END,
    CASE WHEN dx_src IS NOT NULL THEN 'diagnoses_icd:seq_num' END), '') AS evid
  FROM base)"""

QUERIES = {
    "event_classifier": Bound(event_classifier, _SQL_CLASSIFIER),
    "asof_latest": Bound(asof_latest, _SQL_ASOF),
    "exposure_flags": Bound(exposure_flags, _SQL_FLAGS),
    "prior_history": Bound(prior_history, _SQL_HISTORY),
    "covariate_matrix": Bound(covariate_matrix, _SQL_MATRIX),
    "tiered_rule": Bound(
        tiered_rule,
        "WITH" + SQL_RULE + f"""
SELECT stay_id, subject_id, strftime(fired, '{_T}') AS suspicion_time_rule, fired_by AS suspicion_time_rule_source,
  conf AS rule_confidence, src AS infection_source_rule, src_by AS infection_source_rule_source,
  trig AS rule_trigger, evid AS evidence_source,
  CASE WHEN fired IS NOT NULL THEN NULL WHEN la_t IS NOT NULL OR wb_t IS NOT NULL THEN 'only_tier3_supporting_signals'
       ELSE 'no_tier1_or_tier2_signal' END AS rule_no_fire_reason,
  note_id AS first_note_evidence_id, phrase AS first_note_match_phrase FROM labels""",
    ),
    "rule_summary": Bound(
        rule_summary,
        "WITH" + SQL_RULE + """
SELECT count(*) AS labeled_row_count, count(fired) AS suspicion_time_rule_count,
  count(*) - count(fired) AS null_rule_count, count(note_t) AS tier1_note_evidence_count,
  count(ab_t) AS tier2_antibiotic_administration_count, count(bc_t) AS tier2_blood_culture_order_count,
  count(la_t) AS tier3_lactate_count, count(wb_t) AS tier3_abnormal_wbc_count,
  count(src) AS infection_source_rule_count FROM labels""",
    ),
    "rule_category_counts": Bound(
        rule_category_counts,
        "WITH" + SQL_RULE + """
SELECT 'suspicion_time_rule_source' AS category, fired_by AS label, count(*) AS rows FROM labels WHERE fired_by IS NOT NULL GROUP BY 2
UNION ALL SELECT 'rule_confidence', conf, count(*) FROM labels GROUP BY 2
UNION ALL SELECT 'infection_source_rule', src, count(*) FROM labels WHERE src IS NOT NULL GROUP BY 2""",
    ),
}
