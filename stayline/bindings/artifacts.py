"""Bindings of stage artifacts: files, policies, predictor rows, design matrix, guards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayline.bindings import Bound, micros, rounded, table
from stayline.bindings.effects import units
from stayline.bindings.judgements import raw_reviews
from stayline.bindings.outcomes import SQL_DATASETS, datasets, predictions
from stayline.bindings.texts import BUDGET, _SQL_BUDGET, conversation_notes
from stayline.bindings.timelines import SQL_RULE, rule_labels
from stayline.functions.typing import lenient_bool
from stayline.operators import causal as ca, checks as ck, evaluate as ev, labels as lb, notes as nt, scale
from stayline.session import shared_folder
from stayline.sources import sinks, tables

_T = "%Y-%m-%d %H:%M:%S.%f"


def artifact_files(spark, sf):
    """Task bundles, reviewer files and manifests written, discovered and read back."""
    root = f"{shared_folder(spark)}/stayline-files-{uuid.uuid4().hex}"
    bundles = nt.note_bundles(nt.budgeted_notes(conversation_notes(spark, sf), **BUDGET))
    sinks.write_json(bundles, f"{root}/note_tasks")
    tasks = tables.task_bundles(spark, f"{root}/note_tasks")
    task_row = tasks.agg(
        F.lit("tasks").alias("artifact"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.size("notes")).alias("items"), F.max("task_id").alias("last"),
    )

    reviews = raw_reviews(spark, sf)
    sinks.write_per_key(reviews, "reviewer_id", f"{root}/reviews", kind="csv")
    found = tables.discovered_folders(spark, f"{root}/reviews", "reviewer_id_folder=").orderBy("folder")
    folders = [r["folder"] for r in found.collect()]  # one per reviewer
    back = tables.label_files(spark, folders, ("task_id", "reviewer_id", "annotation_status"))
    review_row = back.agg(
        F.lit("reviews").alias("artifact"), F.count(F.lit(1)).alias("rows"),
        F.count_if(lenient_bool(F.col("suspected_sepsis"))).alias("items"), F.max("task_id").alias("last"),
    )

    listed = tables.discovered_folders(spark, root, "note")
    folder_row = listed.agg(
        F.lit("folders").alias("artifact"), F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("items"),
        F.max(F.element_at(F.split("folder", "/"), -1)).alias("last"),
    )

    asked = reviews.select("task_id", "reviewer_id").groupBy().agg(
        F.array_sort(F.collect_set("reviewer_id")).alias("reviewers")
    )
    manifest = asked.select(F.transform("reviewers", lambda r: F.struct(r.alias("reviewer_id"))).alias("assignments"))
    sinks.write_json(manifest, f"{root}/manifest")
    entries = tables.manifest_rows(spark, f"{root}/manifest", "assignments")
    manifest_row = entries.agg(
        F.lit("manifest").alias("artifact"), F.count(F.lit(1)).alias("rows"),
        F.count_distinct("reviewer_id").alias("items"), F.max("reviewer_id").alias("last"),
    )
    return task_row.unionByName(review_row).unionByName(folder_row).unionByName(manifest_row)


_SQL_FILES = "WITH" + _SQL_BUDGET + """,
lab AS (SELECT 'doc-' || d.doc_id AS task_id, quality = 1 AS good, toxic, lang, n_chars FROM labels JOIN documents d USING (doc_id)),
rv AS (SELECT task_id, 'rev b' AS r, good AS yes FROM lab
  UNION ALL SELECT task_id, 'rev a', CASE WHEN toxic = 1 THEN NOT good ELSE good END FROM lab WHERE n_chars > 700
  UNION ALL SELECT task_id, 'rev c', false FROM lab WHERE lang IN ('de', 'es')
  UNION ALL SELECT task_id, 'rev d', true FROM lab WHERE lang = 'es' AND n_chars > 3000)
SELECT 'tasks' AS artifact, count(DISTINCT stay_id) AS rows, count(*) AS items, max('stay-' || stay_id) AS last FROM k
UNION ALL SELECT 'reviews', count(*), count(*) FILTER (yes), max(task_id) FROM rv
UNION ALL SELECT 'folders', 1, 1, 'note_tasks'
UNION ALL SELECT 'manifest', count(DISTINCT r), count(DISTINCT r), max(r) FROM rv"""


def array_outputs(spark, sf):
    """Model outputs written as files of one JSON array each and read back in splits."""
    path = f"{shared_folder(spark)}/stayline-arrays-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents")
    found = F.struct((F.col("lang") == "en").alias("suspected_sepsis"), F.col("source").alias("infection_source"))
    row = F.struct(F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("raw_response_text"), found.alias("normalized_extraction"))
    file = F.coalesce(F.pmod("doc_id", F.lit(16)), F.lit(16))  # the last for rows without an id
    sinks.write_arrays(docs.select("doc_id", F.to_json(row).alias("row")), file, 17, path)
    back = tables.model_outputs(spark, path, array=True)
    return back.select(
        "task_id", F.md5("raw_response_text").alias("text_md5"), F.col("normalized_extraction.suspected_sepsis").alias("suspected_sepsis"),
        F.col("normalized_extraction.infection_source").alias("infection_source"),
    )


_SQL_ARRAY = """SELECT CAST(doc_id AS VARCHAR) AS task_id, md5(text) AS text_md5, lang = 'en' AS suspected_sepsis, source AS infection_source FROM documents"""


def label_rows(spark, sf):
    """Reviewer files read together: each row's place in its file."""
    path = f"{shared_folder(spark)}/stayline-labels-{uuid.uuid4().hex}"
    reviews = raw_reviews(spark, sf).withColumn("file", F.col("reviewer_id"))
    sorted_rows = reviews.repartition("file").sortWithinPartitions("file", "task_id")
    sorted_rows.write.partitionBy("file").option("header", True).option("escape", '"').csv(path)
    back = tables.label_files(spark, [path], ("task_id", "reviewer_id", "annotation_status"))
    return back.select("reviewer_id", "task_id", "row_number")


_SQL_ROWS = """WITH lab AS (SELECT 'doc-' || d.doc_id AS task_id, quality = 1 AS good, toxic, lang, n_chars FROM labels JOIN documents d USING (doc_id)),
rv AS (SELECT task_id, 'rev b' AS r FROM lab UNION ALL SELECT task_id, 'rev a' FROM lab WHERE n_chars > 700
  UNION ALL SELECT task_id, 'rev c' FROM lab WHERE lang IN ('de', 'es') UNION ALL SELECT task_id, 'rev d' FROM lab WHERE lang = 'es' AND n_chars > 3000)
SELECT r AS reviewer_id, task_id, 1 + row_number() OVER (PARTITION BY r ORDER BY task_id) AS row_number FROM rv"""


def note_policy(spark, sf):
    """Documents of the one language domain that the policy approves."""
    docs = table(spark, sf, "documents")
    policies = docs.groupBy(F.col("lang").alias("domain")).agg(F.count(F.lit(1)).alias("notes")).select(
        "domain", F.concat(F.lit("/notes/"), "domain").alias("parquet_path"), "notes",
        (F.col("domain") == "en").alias("allowed_for_gold_annotations"),
        F.lit("secondary").alias("reason"),
    )
    path, chosen_by = nt.choose_notes(policies)
    approved = nt.approved_domain(policies)
    return docs.where(F.col("lang") == approved).agg(
        F.lit(path).alias("path"), F.lit(chosen_by).alias("chosen_by"),
        F.count(F.lit(1)).alias("notes"), F.sum("n_chars").alias("chars"),
    )


def rule_predictions(spark, sf):
    """Rule labels as predictions of the users that ever purchased for more than 100."""
    buyers = table(spark, sf, "events").where("event_type = 'purchase' AND value > 100").select(
        F.col("user_id").alias("subject_id")
    ).distinct()
    rules = rule_labels(spark, sf)
    tasks = rules.join(buyers, "subject_id", "left_semi").select(
        F.concat(F.lit("stay-"), F.col("stay_id").cast("string")).alias("task_id"), "stay_id"
    )
    out = ev.as_predictor(ev.rule_predictions(rules, tasks), "x_rule", "rule_based", "rule_based_baseline")
    return out.withColumn("suspicion_time", micros("suspicion_time"))


def eligible_rows(spark, sf):
    """Input, eligible and excluded rows and distinct subjects per predictor."""
    return datasets(spark, sf).groupBy("predictor_name").agg(
        F.count(F.lit(1)).alias("input_row_count"),
        F.count_if("analysis_eligible").alias("analysis_row_count"),
        F.count_if(~F.col("analysis_eligible")).alias("excluded_row_count"),
        F.count_distinct("subject_id").alias("subjects"),
    )


def dataset_files(spark, sf):
    """Analysis datasets as sorted CSV, read back with types and checked for their columns."""
    path = f"{shared_folder(spark)}/stayline-datasets-{uuid.uuid4().hex}"
    rows = datasets(spark, sf)
    sinks.write_csv(rows, path, order=["predictor_name", "task_id"])
    back = tables.analysis_files(spark, path)
    ck.same_schema("datasets", back.columns, rows.columns)
    ck.require_columns(back, ("task_id", "predictor_name", "analysis_eligible"), "datasets")
    known = F.lit(len(tables.column_set(back) & set(rows.columns)) == len(rows.columns))
    return back.groupBy("predictor_name").agg(
        F.count(F.lit(1)).alias("input_row_count"), F.count_if("analysis_eligible").alias("analysis_row_count"),
        F.count_distinct("subject_id").alias("subjects"), F.count("suspicion_time").alias("timed"), F.max(known).alias("all_columns"),
    )


def disagreement_subset(spark, sf):
    """Rows of all predictors on tasks where the models disagree materially."""
    rows = predictions(spark, sf)
    ids = ev.material_disagreement(rows, ["model_1", "model_2"]).select("task_id")
    kept = rows.join(ids, "task_id", "left_semi")
    return kept.select("task_id", "predictor_name", "suspected_sepsis", micros("suspicion_time").alias("suspicion_time"))


def expected_reviewers(spark, sf):
    """Expected reviewers per task from assignment rows with repeats."""
    out = lb.expected_reviewers(raw_reviews(spark, sf).select("task_id", "reviewer_id"))
    return out.withColumn("expected_reviewer_ids", F.array_join("expected_reviewer_ids", "|"))


def design_matrix(spark, sf):
    """Standardised, one-hot and flag columns, fitted on one dataset and applied to all."""
    rows = units(spark, sf).withColumn("strong", F.col("severity") > 100)
    fitted = ca.fit_preprocessing(
        rows.where(F.col("dataset") == "click"), rows, ["k", "hour", "severity"], ["unit"], ["strong"]
    )
    out = rows.select("event_id", *fitted.columns())
    return rounded(out, *[c for c in out.columns if c != "event_id"])


def estimation_guards(spark, sf):
    """First violated guard per order status, over lines as units."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderpriority").alias("dataset"), "l_quantity",
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("l_quantity") > 25).alias("treatment"),
        (F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("R")).otherwise(F.col("l_returnflag")) == "R").alias("event"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("l_discount")).otherwise(F.lit(1.0)).alias("followup_duration_days"),
    )
    rows = rows.withColumn("weight", F.when(F.col("dataset") == "3-MEDIUM", F.col("l_quantity") * 3).otherwise(F.lit(1.0)))
    return ca.estimation_guards(rows, weight="weight")


def exact_quantiles(spark, sf):
    """Quantiles of line prices per return flag."""
    out = scale.exact_quantiles(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]
    )
    return rounded(out, "quantile")


def prompts(spark, sf):
    """Rendered note blocks with fallbacks for missing ids and times."""
    notes = conversation_notes(spark, sf).withColumn("note_id", F.when(F.col("note_charttime").isNotNull(), F.col("note_id")))
    tasks = nt.note_bundles(nt.budgeted_notes(notes, max_notes=6, max_chars=4000))
    text = nt.rendered_notes(F.col("notes"))
    return tasks.select("task_id", F.md5(text).alias("text_md5"), F.length(text).alias("chars"))


_SQL_PROMPTS = r"""WITH n AS (SELECT conv_id AS stay_id, text, CASE WHEN turn < 5 THEN TIMESTAMP '2024-01-01' + to_hours(turn) END AS ct,
  CASE WHEN turn < 5 THEN turn || '-' || role END AS note_id, length(text) AS c FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS rk, sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n
  WINDOW w AS (PARTITION BY stay_id ORDER BY ct NULLS LAST, note_id NULLS LAST, text)),
t AS (SELECT stay_id, string_agg('[Note ' || rk || ']' || chr(10) || 'note_id: ' || coalesce(note_id, 'note-' || rk) || chr(10) || 'charttime: '
    || coalesce(strftime(ct, '%Y-%m-%d %H:%M:%S'), 'unknown') || chr(10) || 'text:' || chr(10)
    || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10) || chr(10) ORDER BY rk) AS t FROM r WHERE rk <= 6 AND run <= 4000 GROUP BY 1)
SELECT 'stay-' || stay_id AS task_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS chars FROM t"""

QUERIES = {
    "array_outputs": Bound(array_outputs, _SQL_ARRAY),
    "label_rows": Bound(label_rows, _SQL_ROWS),
    "artifact_files": Bound(artifact_files, _SQL_FILES),
    "note_policy": Bound(
        note_policy,
        """SELECT '/notes/en' AS path, 'manifest_approved' AS chosen_by, count(*) AS notes, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents WHERE lang = 'en'""",
    ),
    "rule_predictions": Bound(
        rule_predictions,
        "WITH" + SQL_RULE + f"""
SELECT 'stay-' || stay_id AS task_id, 'x_rule' AS predictor_name, 'rule_based' AS predictor_type, 'rule_based_baseline' AS predictor_id,
  'ok' AS prediction_status, fired IS NOT NULL AS suspected_sepsis, strftime(fired, '{_T}') AS suspicion_time,
  src AS infection_source, CAST(NULL AS VARCHAR) AS evidence_span, CAST(NULL AS DOUBLE) AS confidence
FROM labels WHERE subject_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)""",
    ),
    "eligible_rows": Bound(
        eligible_rows,
        "WITH" + SQL_DATASETS + """ SELECT predictor_name, count(*) AS input_row_count,
  count(*) FILTER (analysis_eligible) AS analysis_row_count, count(*) FILTER (NOT analysis_eligible) AS excluded_row_count,
  count(DISTINCT subject_id) AS subjects FROM ds GROUP BY 1""",
    ),
    "dataset_files": Bound(
        dataset_files,
        "WITH" + SQL_DATASETS + """ SELECT predictor_name, count(*) AS input_row_count,
  count(*) FILTER (analysis_eligible) AS analysis_row_count, count(DISTINCT subject_id) AS subjects,
  count(CASE WHEN suspected_sepsis THEN zero END) AS timed, true AS all_columns FROM ds GROUP BY 1""",
    ),
    "disagreement_subset": Bound(
        disagreement_subset,
        "WITH" + SQL_DATASETS + f""",
m AS (SELECT task_id FROM pred WHERE predictor_type = 'model' GROUP BY 1
  HAVING min(suspected_sepsis) <> max(suspected_sepsis) OR min(coalesce(trim(src), '')) <> max(coalesce(trim(src), ''))
    OR count(said_at) = 1 OR (count(said_at) = 2 AND epoch_us(max(said_at)) - epoch_us(min(said_at)) > 3600000000))
SELECT task_id, predictor_name, suspected_sepsis, strftime(said_at, '{_T}') AS suspicion_time FROM pred WHERE task_id IN (SELECT task_id FROM m)""",
    ),
    "expected_reviewers": Bound(
        expected_reviewers,
        """WITH lab AS (SELECT 'doc-' || d.doc_id AS task_id, lang, n_chars FROM labels JOIN documents d USING (doc_id))
SELECT task_id, concat_ws('|', CASE WHEN n_chars > 700 THEN 'rev a' END, 'rev b', CASE WHEN lang IN ('de', 'es') THEN 'rev c' END,
  CASE WHEN lang = 'es' AND n_chars > 3000 THEN 'rev d' END) AS expected_reviewer_ids FROM lab""",
    ),
    "design_matrix": Bound(
        design_matrix,
        """WITH u AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, extract(hour FROM ts) AS h, value, user_id FROM events),
m AS (SELECT avg(k) mk, stddev_pop(k) sk, avg(h) mh, stddev_pop(h) sh, avg(value) mv, stddev_pop(value) sv FROM u WHERE event_type = 'click')
SELECT event_id, round((k - mk) / sk, 6) AS x0, round((h - mh) / sh, 6) AS x1, round((value - mv) / sv, 6) AS x2,
  CAST(user_id % 3 = 0 AS DOUBLE) AS x3, CAST(user_id % 3 = 1 AS DOUBLE) AS x4, CAST(user_id % 3 = 2 AS DOUBLE) AS x5,
  CAST(value > 100 AS DOUBLE) AS x6 FROM u CROSS JOIN m""",
    ),
    "estimation_guards": Bound(
        estimation_guards,
        """SELECT o_orderpriority AS dataset, CASE WHEN o_orderpriority = '1-URGENT' THEN 'treatment_missing'
  WHEN o_orderpriority = '2-HIGH' THEN 'one_outcome'
  WHEN o_orderpriority = '5-LOW' AND min(l_discount) <= 0 THEN 'followup_not_positive'
  WHEN o_orderpriority = '3-MEDIUM' AND max(l_quantity) * 3 > 100 THEN 'extreme_weight' END AS verdict
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    ),
    "exact_quantiles": Bound(
        exact_quantiles,
        """SELECT l_returnflag, p AS probability, round(list_extract(q, i), 6) AS quantile FROM (
  SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]) AS q FROM lineitem GROUP BY 1)
CROSS JOIN (VALUES (1, 0.0::DOUBLE), (2, 0.01), (3, 0.25), (4, 0.5), (5, 0.95), (6, 0.99), (7, 1.0)) v(i, p)""",
    ),
    "prompts": Bound(prompts, _SQL_PROMPTS),
}
