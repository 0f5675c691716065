"""Cohorts, windowed signals and first-match payloads.

Customers are subjects, orders are stays (open orders have no episode), order lines with
their part are the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.bindings import Bound, table, with_micros
from stayline.functions.text import contains_any, first_label, included, lowered
from stayline.functions.times import add_hours
from stayline.operators import cohort as co, signals as sg
from stayline.session import cut_lineage

WIDE_DAYS = 720

ANTIBIOTIC = r"(ring|bolt|gear)"
TOPICAL = r"(small|hot)"
ROUTE = r"(^|[^a-z])(promo|eco)([^a-z]|$)|large"
CONTEXT_RULES = (("metal", r"(bolt|gear)"), ("round", r"\bring\b"), ("device", r"(gizmo|widget)"))


def stays(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_orderdate").alias("icu_intime"),
        add_hours(F.col("o_orderdate"), 240).alias("icu_outtime"),
    )


def episodes(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P")
    return o.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        add_hours(F.col("o_orderdate"), -24).alias("admittime"),
        add_hours(F.col("o_orderdate"), 288).alias("dischtime"),
    )


def subjects(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("subject_id"), (F.col("c_nationkey") + 10).alias("anchor_age")
    )


def order_cohort(spark, sf, days: int) -> DataFrame:
    return co.first_stay_cohort(
        stays(spark, sf), episodes(spark, sf), subjects(spark, sf),
        hours_before=24 * days, hours_after=24 * days,
    )


def line_events(spark, sf) -> DataFrame:
    """Order lines as events; the start of kept lines is unknown, their stop counts."""
    lines = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    start = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("hadm_id"),
        F.coalesce(start, add_hours(F.col("l_shipdate"), 24)).alias("time"),
        F.col("p_name").alias("drug"),
        F.col("p_type").alias("route"),
        F.col("l_linenumber").alias("seq_num"),
        F.col("l_quantity").alias("valuenum"),
        F.col("l_partkey").alias("itemid"),
    )


def signal_tables(spark, sf, cohort) -> list[DataFrame]:
    events = line_events(spark, sf)
    value = F.col("valuenum")
    wide = sg.windowed_signals(
        cohort, events, ["hadm_id"], "time",
        {
            "antibiotic": included(
                F.col("drug"), ANTIBIOTIC, (F.col("drug"), TOPICAL), (F.col("route"), ROUTE)
            ),
            "blood_culture": contains_any([F.col("drug"), F.col("route")], "gizmo")
            | contains_any([F.col("route")], "economy"),
            "abnormal": (value < 4) | (value > 45),
        },
    )
    items = sg.dictionary_items(
        table(spark, sf, "part").withColumnRenamed("p_partkey", "itemid"),
        lowered(F.col("p_name")) == "old bolt",
    )
    labs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_shipdate").alias("time"),
        F.col("l_partkey").alias("itemid"),
    )
    lactate = sg.windowed_signals(
        cohort, sg.of_items(labs, items), ["hadm_id"], "time", {"lactate": F.lit(True)}
    )
    return [wide, lactate]


def candidates(spark, sf) -> DataFrame:
    cohort = cut_lineage(order_cohort(spark, sf, WIDE_DAYS))
    flagged = co.attach_signals(
        cohort,
        signal_tables(spark, sf, cohort),
        {
            "has_antibiotic_exposure": "antibiotic_event_count",
            "has_lactate_measurement": "lactate_event_count",
            "has_blood_culture": "blood_culture_event_count",
        },
    )
    return co.with_any_signal(flagged)


SQL_COHORT = """
cohort AS (
  SELECT subject_id, hadm_id, stay_id, anchor_age, icu_intime,
         icu_intime - INTERVAL {days} DAY AS study_window_start,
         icu_intime + INTERVAL {days} DAY AS study_window_end
  FROM (
    SELECT s.o_custkey AS subject_id, s.o_orderkey AS hadm_id, s.o_orderkey AS stay_id,
           c.c_nationkey + 10 AS anchor_age, s.o_orderdate AS icu_intime,
           row_number() OVER (PARTITION BY s.o_custkey ORDER BY s.o_orderdate, s.o_orderkey) AS rk
    FROM orders s
    JOIN orders e ON e.o_custkey = s.o_custkey AND e.o_orderkey = s.o_orderkey AND e.o_orderstatus <> 'P'
    JOIN customer c ON c.c_custkey = s.o_custkey
    WHERE c.c_nationkey + 10 >= 18)
  WHERE rk = 1)"""

SQL_EVENTS = """
line_events AS (
  SELECT l_orderkey AS hadm_id,
         coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, l_shipdate + INTERVAL 1 DAY) AS time,
         p_name AS drug, p_type AS route, l_linenumber AS seq_num, l_quantity AS valuenum
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_T = "%Y-%m-%d %H:%M:%S.%f"

SQL_SIGNALS = (
    SQL_COHORT.format(days=WIDE_DAYS)
    + ","
    + SQL_EVENTS
    + """,
hits AS (
  SELECT c.stay_id, e.* FROM cohort c JOIN line_events e ON e.hadm_id = c.hadm_id
  WHERE e.time BETWEEN c.study_window_start AND c.study_window_end),
ab AS (SELECT stay_id, min(time) t, count(*) n FROM hits
  WHERE regexp_matches(lower(drug), '(ring|bolt|gear)') AND NOT regexp_matches(lower(drug), '(small|hot)')
    AND NOT regexp_matches(lower(route), '(^|[^a-z])(promo|eco)([^a-z]|$)|large') GROUP BY 1),
bc AS (SELECT stay_id, min(time) t, count(*) n FROM hits
  WHERE lower(drug) LIKE '%gizmo%' OR lower(route) LIKE '%gizmo%' OR lower(route) LIKE '%economy%' GROUP BY 1),
abn AS (SELECT stay_id, min(time) t, count(*) n FROM hits WHERE valuenum < 4 OR valuenum > 45 GROUP BY 1),
lac AS (SELECT c.stay_id, min(l_shipdate) t, count(*) n FROM cohort c JOIN lineitem ON l_orderkey = c.hadm_id
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE lower(p_name) = 'old bolt')
    AND l_shipdate BETWEEN study_window_start AND study_window_end GROUP BY 1),
candidate AS (
  SELECT c.*, ab.t AS first_antibiotic_time, ab.n AS antibiotic_event_count,
         bc.t AS first_blood_culture_time, bc.n AS blood_culture_event_count,
         abn.t AS first_abnormal_time, abn.n AS abnormal_event_count,
         lac.t AS first_lactate_time, lac.n AS lactate_event_count,
         ab.n IS NOT NULL AS has_antibiotic_exposure, lac.n IS NOT NULL AS has_lactate_measurement,
         bc.n IS NOT NULL AS has_blood_culture,
         CAST(ab.n IS NOT NULL AS INTEGER) + CAST(lac.n IS NOT NULL AS INTEGER)
           + CAST(bc.n IS NOT NULL AS INTEGER) AS signal_count
  FROM cohort c LEFT JOIN ab USING (stay_id) LEFT JOIN bc USING (stay_id)
  LEFT JOIN abn USING (stay_id) LEFT JOIN lac USING (stay_id)
  WHERE ab.n IS NOT NULL OR bc.n IS NOT NULL OR lac.n IS NOT NULL)"""
)


def first_stay_cohort(spark, sf):
    out = order_cohort(spark, sf, 180).select(
        "subject_id", "hadm_id", "stay_id", "anchor_age", "icu_intime",
        "study_window_start", "study_window_end",
    )
    return with_micros(out, "icu_intime", "study_window_start", "study_window_end")


def windowed_signals(spark, sf):
    cohort = order_cohort(spark, sf, WIDE_DAYS)
    wide = signal_tables(spark, sf, cohort)[0]
    return with_micros(
        wide, "first_antibiotic_time", "first_blood_culture_time", "first_abnormal_time"
    )


def dictionary_signal(spark, sf):
    cohort = order_cohort(spark, sf, WIDE_DAYS)
    return with_micros(signal_tables(spark, sf, cohort)[1], "first_lactate_time")


_CANDIDATE_COLUMNS = [
    "subject_id", "hadm_id", "stay_id", "anchor_age",
    "first_antibiotic_time", "antibiotic_event_count",
    "first_lactate_time", "lactate_event_count",
    "first_blood_culture_time", "blood_culture_event_count",
    "has_antibiotic_exposure", "has_lactate_measurement", "has_blood_culture", "signal_count",
]
_CANDIDATE_TIMES = ["first_antibiotic_time", "first_lactate_time", "first_blood_culture_time"]
_SQL_CANDIDATE_LIST = ", ".join(
    f"strftime({c}, '{_T}') AS {c}" if c in _CANDIDATE_TIMES else c for c in _CANDIDATE_COLUMNS
)


def candidate_cohort(spark, sf):
    return with_micros(candidates(spark, sf).select(*_CANDIDATE_COLUMNS), *_CANDIDATE_TIMES)


def hash_sample(spark, sf):
    return co.hash_sample(
        candidates(spark, sf).select("subject_id", "hadm_id", "stay_id", "signal_count"),
        ["subject_id", "hadm_id", "stay_id"], 200,
    )


def cohort_summary(spark, sf):
    found = cut_lineage(candidates(spark, sf))
    flags = ["has_antibiotic_exposure", "has_lactate_measurement", "has_blood_culture"]
    sampled = co.hash_sample(found, ["subject_id", "hadm_id", "stay_id"], 200)
    return co.cohort_summary(stays(spark, sf), order_cohort(spark, sf, WIDE_DAYS), found, sampled, flags)


def first_match_payload(spark, sf):
    cohort = order_cohort(spark, sf, WIDE_DAYS)
    events = line_events(spark, sf).withColumn(
        "source", first_label(lowered(F.col("route"), F.col("drug")), CONTEXT_RULES)
    )
    found = sg.windowed_signals(
        cohort, events, ["hadm_id"], "time", {},
        [
            sg.FirstMatch(
                F.col("source").isNotNull(), ["route", "drug"],
                {
                    "first_culture_context_source": "source",
                    "first_culture_context_specimen": "route",
                    "first_culture_context_test": "drug",
                },
                "first_culture_context_time", "culture_context_event_count",
            )
        ],
    )
    return with_micros(found, "first_culture_context_time")


def diagnosis_source(spark, sf):
    cohort = order_cohort(spark, sf, WIDE_DAYS)
    coded = line_events(spark, sf).select(
        "hadm_id", "seq_num", F.concat_ws(" ", "drug", "route").alias("title")
    ).withColumn("source", first_label(lowered(F.col("title")), CONTEXT_RULES[:2]))
    matched = coded.where(F.col("source").isNotNull()).join(cohort.select("hadm_id", "stay_id"), "hadm_id")
    return sg.first_match(
        matched, ["seq_num", "title"],
        {"first_diagnosis_source": "source", "first_diagnosis_title": "title"},
        count_name="diagnosis_match_count",
    )


_SQL_CONTEXT = """CASE WHEN regexp_matches({t}, '(bolt|gear)') THEN 'metal'
  WHEN regexp_matches({t}, '\\bring\\b') THEN 'round'
  WHEN regexp_matches({t}, '(gizmo|widget)') THEN 'device' END"""

QUERIES = {
    "first_stay_cohort": Bound(
        first_stay_cohort,
        "WITH" + SQL_COHORT.format(days=180) + f"""
SELECT subject_id, hadm_id, stay_id, anchor_age, strftime(icu_intime, '{_T}') AS icu_intime,
  strftime(study_window_start, '{_T}') AS study_window_start,
  strftime(study_window_end, '{_T}') AS study_window_end FROM cohort""",
    ),
    "windowed_signals": Bound(
        windowed_signals,
        "WITH" + SQL_SIGNALS + f"""
SELECT coalesce(ab.stay_id, bc.stay_id, abn.stay_id) AS stay_id,
  strftime(ab.t, '{_T}') AS first_antibiotic_time, ab.n AS antibiotic_event_count,
  strftime(bc.t, '{_T}') AS first_blood_culture_time, bc.n AS blood_culture_event_count,
  strftime(abn.t, '{_T}') AS first_abnormal_time, abn.n AS abnormal_event_count
FROM ab FULL JOIN bc ON ab.stay_id = bc.stay_id
  FULL JOIN abn ON abn.stay_id = coalesce(ab.stay_id, bc.stay_id)""",
    ),
    "dictionary_signal": Bound(
        dictionary_signal,
        "WITH" + SQL_SIGNALS + f"""
SELECT stay_id, strftime(t, '{_T}') AS first_lactate_time, n AS lactate_event_count FROM lac""",
    ),
    "candidate_cohort": Bound(
        candidate_cohort, "WITH" + SQL_SIGNALS + f" SELECT {_SQL_CANDIDATE_LIST} FROM candidate"
    ),
    "hash_sample": Bound(
        hash_sample,
        "WITH" + SQL_SIGNALS + """
SELECT subject_id, hadm_id, stay_id, signal_count FROM candidate
ORDER BY md5(CAST(subject_id AS VARCHAR) || '-' || CAST(hadm_id AS VARCHAR) || '-' || CAST(stay_id AS VARCHAR))
LIMIT 200""",
    ),
    "cohort_summary": Bound(
        cohort_summary,
        "WITH" + SQL_SIGNALS + """
SELECT 'total_stays' AS measure, count(*) AS rows FROM orders
UNION ALL SELECT 'adult_first_stays', count(*) FROM cohort
UNION ALL SELECT 'has_antibiotic_exposure', count(*) FROM candidate WHERE has_antibiotic_exposure
UNION ALL SELECT 'has_lactate_measurement', count(*) FROM candidate WHERE has_lactate_measurement
UNION ALL SELECT 'has_blood_culture', count(*) FROM candidate WHERE has_blood_culture
UNION ALL SELECT 'candidate_cohort', count(*) FROM candidate
UNION ALL SELECT 'sampled_cohort', least(200, count(*)) FROM candidate""",
    ),
    "first_match_payload": Bound(
        first_match_payload,
        "WITH" + SQL_COHORT.format(days=WIDE_DAYS) + "," + SQL_EVENTS + ", found AS (SELECT c.stay_id, e.*, "
        + _SQL_CONTEXT.format(t="lower(route || ' ' || drug)")
        + f""" AS source FROM cohort c JOIN line_events e ON e.hadm_id = c.hadm_id
  WHERE e.time BETWEEN study_window_start AND study_window_end),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY time, route, drug) rk
  FROM found WHERE source IS NOT NULL)
SELECT stay_id, strftime(min(time), '{_T}') AS first_culture_context_time,
  max(CASE WHEN rk = 1 THEN source END) AS first_culture_context_source,
  max(CASE WHEN rk = 1 THEN route END) AS first_culture_context_specimen,
  max(CASE WHEN rk = 1 THEN drug END) AS first_culture_context_test,
  count(*) AS culture_context_event_count FROM ranked GROUP BY stay_id""",
    ),
    "diagnosis_source": Bound(
        diagnosis_source,
        "WITH" + SQL_COHORT.format(days=WIDE_DAYS) + "," + SQL_EVENTS + """,
found AS (SELECT c.stay_id, seq_num, drug || ' ' || route AS title,
  CASE WHEN regexp_matches(lower(drug || ' ' || route), '(bolt|gear)') THEN 'metal'
       WHEN regexp_matches(lower(drug || ' ' || route), '\\bring\\b') THEN 'round' END AS source
  FROM cohort c JOIN line_events e ON e.hadm_id = c.hadm_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY seq_num, title, source) rk
  FROM found WHERE source IS NOT NULL)
SELECT stay_id, max(CASE WHEN rk = 1 THEN source END) AS first_diagnosis_source,
  max(CASE WHEN rk = 1 THEN title END) AS first_diagnosis_title,
  count(*) AS diagnosis_match_count FROM ranked GROUP BY stay_id""",
    ),
}
