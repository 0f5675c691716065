"""Source, sink, count and data-quality check bindings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayline.bindings import Bound, table
from stayline.bindings.judgements import normalized, predictors
from stayline.bindings.outcomes import SQL_DATASETS, datasets, predictions, tasks
from stayline.bindings.timelines import TIER1, TIER2, lookups, purchase_rows, rule_labels
from stayline.functions.typing import typed
from stayline.operators import checks as ck
from stayline.session import shared_folder
from stayline.sources import sinks, tables

KEYS = {
    "customer": "c_custkey", "documents": "doc_id", "events": "user_id",
    "lineitem": "l_orderkey", "orders": "o_custkey", "labels": "doc_id",
}


def table_counts(spark, sf):
    named = {name: table(spark, sf, name) for name in KEYS}
    return ck.table_counts({**named, "discharge": None}, KEYS)


_SQL_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, count(DISTINCT {k}) AS distinct_keys FROM {n}" for n, k in KEYS.items()
) + " UNION ALL SELECT 'discharge', 0, 0"


def io_round_trip(spark, sf):
    """Events written as CSV, JSON lines, Parquet and one folder per type, and read back."""
    root = f"{shared_folder(spark)}/stayline-io-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    columns = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    kinds = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "value": "double"}
    sinks.write_csv(events, f"{root}/csv", columns)
    sinks.write_json(events, f"{root}/json")
    sinks.to_silver(events, f"{root}/silver", ["user_id"], ["event_type", "ts"])
    sinks.write_per_key(events, "event_type", f"{root}/keyed")
    back = {
        "csv": typed(tables.text_table(spark, f"{root}/csv", columns), kinds),
        "json": spark.read.schema(events.schema).json(f"{root}/json"),
        "parquet": tables.note_table(spark, f"{root}/silver", columns),
        "per_key": spark.read.parquet(f"{root}/keyed"),
    }
    out = None
    for kind, df in back.items():
        one = df.groupBy("event_type").agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("rows"),
            F.round(F.sum("value"), 4).alias("value"),
            F.count_distinct("user_id").alias("users"),
            F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"),
            F.max(F.md5("props")).alias("props_md5"),
        )
        out = one if out is None else out.unionByName(one)
    return out


_SQL_IO = """SELECT kind, event_type, count(*) AS rows, round(sum(value), 4) AS value, count(DISTINCT user_id) AS users,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, max(md5(props)) AS props_md5
FROM events CROSS JOIN (VALUES ('csv'), ('json'), ('parquet'), ('per_key')) k(kind) GROUP BY 1, 2"""


def coverage_checks(spark, sf):
    """Every check on whole tables, also ones that must find something."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    customers, docs = table(spark, sf, "customer"), table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    stack = predictions(spark, sf)
    stays = tasks(spark, sf)
    judged = predictors(spark, sf)
    rules = rule_labels(spark, sf)
    matrix = lookups(spark, sf, purchase_rows(spark, sf))
    as_text = orders.select(
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderkey").cast("string")).alias("hadm_id")
    )
    identity = lines.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("owner")).join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner")), "owner", "left_semi"
    )
    owners = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    windows = stack.join(stays.select("task_id", "study_window_start", "study_window_end"), "task_id")
    late = windows.withColumn("suspicion_time", F.col("suspicion_time") + F.make_dt_interval(F.lit(2)))
    return ck.all_checks(
        [
            ck.duplicate_keys(orders, "duplicate_order", ["o_orderkey"]),
            ck.duplicate_keys(lines, "duplicate_line_number", ["l_orderkey", "l_linenumber"]),
            ck.duplicate_keys(stack, "duplicate_prediction", ["task_id", "predictor_name"]),
            ck.coverage(docs, labels, "label_coverage", "doc_id"),
            ck.identity_mismatch(identity, owners, "owner_differs", "id", ["owner"]),
            ck.unknown_keys(
                orders.select(F.col("o_orderkey").alias("l_orderkey")), lines, "order_without_line", "l_orderkey"
            ),
            ck.unparsable_integers(as_text, "unreadable_id", ["hadm_id"]),
            ck.invalid_predictions(judged),
            ck.positive_without_time(judged),
            ck.time_zero_outside_window(late),
            ck.label_contract(judged.where(F.col("prediction_status") == "ok")),
            ck.rule_traceability(rules, [c for _, c in (TIER1, *TIER2)]),
            ck.rejected_annotations(normalized(spark, sf)),
            ck.missing_values(matrix, ["pre_t0_view", "pre_t0_temperature", "pre_t0_error"]),
            ck.count_where(
                ck.missing_keys(
                    customers.withColumnRenamed("c_custkey", "o_custkey"), orders, "o_custkey"
                ),
                "customer_without_order", F.lit(True),
            ),
            ck.count_where(
                datasets(spark, sf).where("analysis_eligible"), "followup_not_positive",
                F.col("followup_duration_days") <= 0,
            ),
        ]
    )


_SQL_CHECKS = "WITH" + SQL_DATASETS + """,
pp AS (SELECT e.event_id, e.user_id, e.ts AS t0, e.ts - INTERVAL 72 HOUR AS w0 FROM events e WHERE event_type = 'purchase'),
see AS (SELECT pp.event_id, x.event_type, x.value, CASE WHEN x.event_type = 'click' THEN (x.value - 32.0) * (5.0 / 9.0) ELSE x.value END AS warm
  FROM pp JOIN events x ON x.user_id = pp.user_id AND x.ts >= w0 AND x.ts < t0),
lb AS (SELECT d.*, quality, toxic FROM labels l JOIN documents d USING (doc_id))
SELECT 'duplicate_order' AS "check", (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'duplicate_line_number', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_prediction', 0
UNION ALL SELECT 'label_coverage_missing', (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'label_coverage_extra', (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'owner_differs', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey <> o_custkey)
UNION ALL SELECT 'order_without_line', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'unreadable_id', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'invalid_prediction', (SELECT count(*) FROM lb WHERE lang = 'es')
UNION ALL SELECT 'positive_without_time', (SELECT count(*) FROM lb WHERE lower(text) LIKE '%the%' AND lang = 'de')
UNION ALL SELECT 'time_zero_outside_window', (SELECT count(*) FROM pred WHERE said_at IS NOT NULL AND said_at + INTERVAL 48 HOUR NOT BETWEEN ws AND we)
UNION ALL SELECT 'label_contract', (SELECT count(*) FILTER (n_chars > 1500) + count(*) FILTER (n_chars <= 1500 AND lang <> 'de')
   + count(*) FILTER (lang <> 'es') + count(*) FILTER (lower(text) LIKE '%the%') + count(*) FILTER (lower(text) NOT LIKE '%the%' AND lang = 'en') FROM lb)
UNION ALL SELECT 'rule_traceability', 0
UNION ALL SELECT 'rejected_annotation', (SELECT count(*) FROM lb WHERE lang = 'es' AND n_chars > 3000)
UNION ALL SELECT 'missing_pre_t0_view', (SELECT count(*) FROM pp WHERE event_id NOT IN (SELECT event_id FROM see WHERE event_type = 'view' AND value BETWEEN 1 AND 200))
UNION ALL SELECT 'missing_pre_t0_temperature', (SELECT count(*) FROM pp WHERE event_id NOT IN (SELECT event_id FROM see WHERE event_type IN ('click', 'signup') AND warm BETWEEN -10 AND 45))
UNION ALL SELECT 'missing_pre_t0_error', 0
UNION ALL SELECT 'customer_without_order', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
UNION ALL SELECT 'followup_not_positive', (SELECT count(*) FROM ds WHERE analysis_eligible AND followup_duration_days <= 0)"""

QUERIES = {
    "table_counts": Bound(table_counts, _SQL_COUNTS),
    "io_round_trip": Bound(io_round_trip, _SQL_IO),
    "coverage_checks": Bound(coverage_checks, _SQL_CHECKS),
}
