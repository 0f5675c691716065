"""Evaluation, disagreement, reviewer assignment and consensus bindings.

Documents are tasks; the quality label is the gold class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.bindings import Bound, table
from stayline.functions.text import evidence_lines, signature
from stayline.functions.times import add_hours, label_time_text, lenient_time, time_text
from stayline.functions.typing import confidence, lenient_bool
from stayline.operators import evaluate as ev, labels as lb

REVIEWERS = ("rev a", "rev b", "rev c", "rev d")
PANEL = ("x_rule", "model_1", "model_2")


# ------------------------------------------------------------------------- evaluation


def labelled(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.withColumns(
        {
            "task_id": F.concat(F.lit("doc-"), F.col("doc_id").cast("string")),
            "base_time": add_hours(start, F.col("n_chars") / 60.0),
        }
    )


def gold(spark, sf) -> DataFrame:
    positive = F.col("quality") == 1
    return labelled(spark, sf).select(
        "task_id",
        positive.alias("suspected_sepsis"),
        F.when(positive, F.col("base_time")).alias("suspicion_time"),
        F.when(positive, F.col("source")).alias("infection_source"),
    )


def predictors(spark, sf) -> DataFrame:
    docs = labelled(spark, sf)
    base, lang, source = F.col("base_time"), F.col("lang"), F.col("source")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    delay = F.when(lang == "en", 0.0).when(lang == "fr", 1.0).when(lang == "de", 1.02).otherwise(3.5)
    rule = docs.select(
        "task_id",
        (F.col("n_chars") > 1500).alias("suspected_sepsis"),
        F.when(F.col("n_chars") > 1500, add_hours(base, delay)).alias("suspicion_time"),
        F.when(lang == "en", F.concat(F.upper(source), F.lit("  ")))
        .when(lang == "fr", source)
        .when(lang == "es", F.lit("src0"))
        .alias("infection_source"),
        none.alias("evidence_span"),
        number.alias("confidence"),
    )
    one = docs.select(
        "task_id", "lang",
        (F.col("toxic") == 0).alias("suspected_sepsis"),
        F.when(F.col("toxic") == 0, add_hours(base, -1.5)).alias("suspicion_time"),
        source.alias("infection_source"),
        none.alias("evidence_span"),
        F.lit(0.5).alias("confidence"),
    )
    said = F.lower(F.col("text")).contains("the")
    two = docs.select(
        "task_id",
        said.alias("suspected_sepsis"),
        F.when(said & (lang != "de"), base).alias("suspicion_time"),
        F.when(lang == "en", source).alias("infection_source"),
        none.alias("evidence_span"),
        F.lit(0.7).alias("confidence"),
    )
    return ev.stacked(
        [
            ev.as_predictor(rule, "x_rule", "rule_based", "rule_based_baseline"),
            ev.as_predictor(
                one, "model_1", "model", "m-1", status=F.when(lang == "es", "parse_error").otherwise(" ok ")
            ),
            ev.as_predictor(two, "model_2", "model", "m-2"),
        ]
    )


def evaluate_predictors(spark, sf):
    return ev.evaluate_predictors(gold(spark, sf), predictors(spark, sf))


def pairwise_disagreement(spark, sf):
    return ev.pairwise_disagreement(predictors(spark, sf), PANEL)


def material_disagreement(spark, sf):
    return ev.material_disagreement(predictors(spark, sf), ["model_1", "model_2"])


def predictor_stack(spark, sf):
    """Per predictor: rows, valid rows, positives, and how many tasks every predictor shares."""
    stack = predictors(spark, sf)
    shared = ev.shared_tasks(stack.where(F.col("prediction_status") == "ok"), PANEL).withColumn(
        "shared", F.lit(True)
    )
    return (
        stack.join(shared, "task_id", "left")
        .groupBy("predictor_name", "predictor_type", "predictor_id")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("prediction_status") == "ok").alias("valid_count"),
            F.count_if("suspected_sepsis").alias("positive_count"),
            F.count_if(F.col("shared")).alias("shared_count"),
        )
    )


SQL_PREDICTORS = """
lab AS (SELECT 'doc-' || l.doc_id AS task_id, d.*, quality, toxic,
  TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(CAST(round(n_chars / 60.0 * 3600 * 1000000) AS BIGINT)) AS base_time
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
gold AS (SELECT task_id, quality = 1 AS g, CASE WHEN quality = 1 THEN base_time END AS gt,
  CASE WHEN quality = 1 THEN lower(source) END AS gs FROM lab),
pred AS (
  SELECT task_id, 'x_rule' AS p, 'rule_based' AS ty, 'rule_based_baseline' AS id, 'ok' AS st, n_chars > 1500 AS pos,
    CASE WHEN n_chars > 1500 THEN base_time + CASE lang WHEN 'en' THEN INTERVAL 0 SECOND WHEN 'fr' THEN INTERVAL 3600 SECOND
      WHEN 'de' THEN INTERVAL 3672 SECOND ELSE INTERVAL 12600 SECOND END END AS t,
    CASE lang WHEN 'en' THEN upper(source) WHEN 'fr' THEN source WHEN 'es' THEN 'src0' END AS src FROM lab
  UNION ALL SELECT task_id, 'model_1', 'model', 'm-1', CASE WHEN lang = 'es' THEN 'parse_error' ELSE 'ok' END,
    CASE WHEN lang <> 'es' THEN toxic = 0 END, CASE WHEN lang <> 'es' AND toxic = 0 THEN base_time - INTERVAL 90 MINUTE END,
    CASE WHEN lang <> 'es' THEN source END FROM lab
  UNION ALL SELECT task_id, 'model_2', 'model', 'm-2', 'ok', lower(text) LIKE '%the%',
    CASE WHEN lower(text) LIKE '%the%' AND lang <> 'de' THEN base_time END, CASE WHEN lang = 'en' THEN source END FROM lab)"""

_SQL_EVALUATE = "WITH" + SQL_PREDICTORS + """,
j AS (SELECT pred.*, g, gt, gs, CASE WHEN g AND pos THEN abs(epoch_us(t) - epoch_us(gt)) / 3600000000.0 END AS err
  FROM pred JOIN gold USING (task_id) WHERE st = 'ok'),
a AS (SELECT p, ty, id, count(*) AS v, count(*) FILTER (g AND pos) AS tp, count(*) FILTER (NOT g AND pos) AS fp,
  count(*) FILTER (g AND NOT pos) AS fn, count(*) FILTER (NOT g AND NOT pos) AS tn, count(err) AS tn_, avg(err) AS me,
  median(err) AS md, count(*) FILTER (err <= 1) AS w1, count(*) FILTER (err <= 3) AS w3,
  count(*) FILTER (g AND pos AND gs IS NOT NULL AND src IS NOT NULL) AS sc,
  count(*) FILTER (g AND pos AND gs = lower(src)) AS sm,
  count(*) FILTER (g = pos AND t IS NOT DISTINCT FROM gt AND lower(src) IS NOT DISTINCT FROM gs) AS ex
  FROM j GROUP BY 1, 2, 3),
r AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS pr, round(tp / nullif(tp + fn, 0), 6) AS re,
  (SELECT count(*) FROM gold) AS n FROM a)
SELECT p AS predictor_name, ty AS predictor_type, id AS predictor_id, n AS evaluated_task_count,
  v AS valid_prediction_count, round(v / n, 6) AS valid_prediction_rate, tp AS true_positive_count,
  fp AS false_positive_count, fn AS false_negative_count, tn AS true_negative_count, pr AS precision, re AS recall,
  CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 6) END AS f1_score, tn_ AS time_eval_count,
  round(me, 6) AS mean_time_error_hours, round(md, 6) AS median_time_error_hours,
  round(w1 / nullif(tn_, 0), 6) AS within_1h_rate, round(w3 / nullif(tn_, 0), 6) AS within_3h_rate,
  sc AS source_eval_count, round(sm / nullif(sc, 0), 6) AS infection_source_agreement_rate,
  round(ex / nullif(v, 0), 6) AS exact_label_match_rate FROM r"""

_SQL_PAIRWISE = "WITH" + SQL_PREDICTORS + """,
o AS (SELECT pred.*, CASE p WHEN 'x_rule' THEN 1 WHEN 'model_1' THEN 2 ELSE 3 END AS k FROM pred)
SELECT l.p AS left_predictor, l.id AS left_predictor_id, r.p AS right_predictor, r.id AS right_predictor_id,
  count(*) AS shared_task_count,
  count(*) FILTER (l.st = 'ok' AND r.st = 'ok' AND l.pos <> r.pos) AS classification_disagreement_count,
  round(count(*) FILTER (l.st = 'ok' AND r.st = 'ok' AND l.pos <> r.pos) / count(*), 6) AS classification_disagreement_rate,
  count(*) FILTER (l.st = 'ok' AND r.st = 'ok' AND lower(l.src) <> lower(r.src)) AS source_disagreement_count,
  count(*) FILTER (l.st = 'ok' AND r.st = 'ok' AND abs(epoch_us(l.t) - epoch_us(r.t)) > 3600000000) AS time_disagreement_over_1h_count
FROM o l JOIN o r ON l.task_id = r.task_id AND l.k < r.k GROUP BY 1, 2, 3, 4"""

_SQL_MATERIAL = "WITH" + SQL_PREDICTORS + """,
m AS (SELECT task_id, min(pos) <> max(pos) AS class_differs,
  min(coalesce(src, '')) <> max(coalesce(src, '')) AS source_differs,
  count(t) = 1 AS time_partly_missing, count(t) = 2 AND epoch_us(max(t)) - epoch_us(min(t)) > 3600000000 AS time_differs
  FROM pred WHERE p IN ('model_1', 'model_2') GROUP BY 1 HAVING count(*) = 2)
SELECT * FROM m WHERE class_differs OR source_differs OR time_partly_missing OR time_differs"""

_SQL_STACK = "WITH" + SQL_PREDICTORS + """,
s AS (SELECT task_id FROM pred WHERE st = 'ok' GROUP BY 1 HAVING count(DISTINCT p) = 3)
SELECT p AS predictor_name, ty AS predictor_type, id AS predictor_id, count(*) AS row_count,
  count(*) FILTER (st = 'ok') AS valid_count, count(*) FILTER (pos) AS positive_count,
  count(*) FILTER (task_id IN (SELECT task_id FROM s)) AS shared_count FROM pred GROUP BY 1, 2, 3"""


# -------------------------------------------------------------------------- assignment


def assignments(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("task_id"))
    return lb.assign_reviewers(docs, REVIEWERS, fraction=0.2, seed="7")


def reviewer_assignment(spark, sf):
    return assignments(spark, sf)


def assignment_counts(spark, sf):
    return lb.assignment_counts(assignments(spark, sf))


def reviewer_packets(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("task_id"), "lang", "n_chars"
    )
    packets = lb.reviewer_packets(assignments(spark, sf), docs)
    blank = F.concat_ws("", *[F.col(c) for c in (*lb.LABEL_FIELDS, "reviewed_at")])
    return packets.groupBy("reviewer_id", "assignment_role", "annotation_status").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("n_chars").alias("n_chars"), F.max(blank).alias("filled")
    )


_SQL_ASSIGN = """
o AS (SELECT 'doc-' || doc_id AS task_id, lang, n_chars, row_number() OVER (ORDER BY md5('7-doc-' || doc_id), doc_id) - 1 AS pos,
  count(*) OVER () AS n FROM documents),
a AS (SELECT task_id, lang, n_chars, ['rev a', 'rev b', 'rev c', 'rev d'][CAST(pos % 4 + 1 AS INTEGER)] AS reviewer_id, 'primary' AS assignment_role FROM o
  UNION ALL SELECT task_id, lang, n_chars, ['rev a', 'rev b', 'rev c', 'rev d'][CAST((pos % 4 + 1 + pos % 3) % 4 + 1 AS INTEGER)], 'secondary'
  FROM o WHERE pos < greatest(1, round_even(n * 0.2, 0)))"""


# --------------------------------------------------------------------------- consensus


def review_tasks(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("task_id"), "lang", "n_chars"
    )


def raw_reviews(spark, sf) -> DataFrame:
    """Reviewer rows as text, the way label files hold them."""
    docs = labelled(spark, sf)
    good, lang, source = F.col("quality") == 1, F.col("lang"), F.col("source")
    stamp = F.date_format("base_time", "yyyy-MM-dd'T'HH:mm:ss")
    blank = F.lit("")

    def review(reviewer, status, positive, time, place, evidence, score):
        return F.struct(
            F.lit(reviewer).alias("reviewer_id"),
            status.alias("annotation_status"),
            positive.alias("suspected_sepsis"),
            time.alias("suspicion_time"),
            place.alias("infection_source"),
            evidence.alias("evidence_span"),
            score.alias("confidence"),
            F.when(status == "Completed", F.lit("2024-03-01 08:00")).otherwise(blank).alias("reviewed_at"),
        )

    done, skip, pending = F.lit("Completed"), F.lit(" Skipped "), F.lit("pending")
    flipped = F.when(F.col("toxic") == 1, ~good).otherwise(good)
    first = review(
        "rev b", done, F.when(good, " YES ").otherwise("0"), F.when(good, F.concat(stamp, F.lit("Z"))).otherwise(blank),
        F.when(good, source).otherwise(blank), F.concat(lang, F.lit("  \n "), source), F.lit("0.9"),
    )
    second = review(
        "rev a", pending, F.when(flipped, "t").otherwise("No"),
        F.when(flipped, F.concat(stamp, F.lit("+00:00"))).otherwise(blank),
        F.when(flipped, F.concat(F.upper(source), F.lit(" "))).otherwise(blank),
        F.when(lang == "fr", F.concat(lang, F.lit(" "), source)).otherwise(F.concat(F.lit("see "), source)),
        F.lit("0.60"),
    )
    third = review("rev c", F.when(lang == "de", skip).otherwise(pending), blank, blank, blank, blank, blank)
    broken = review("rev d", done, F.lit("yes"), stamp, blank, source, F.lit("1.2"))
    rows = F.filter(
        F.array(
            first,
            F.when(F.col("n_chars") > 700, second),
            F.when(lang.isin("de", "es"), third),
            F.when((lang == "es") & (F.col("n_chars") > 3000), broken),
        ),
        lambda r: r.isNotNull(),
    )
    return docs.select("task_id", F.explode(rows).alias("r")).select("task_id", "r.*")


def normalized(spark, sf) -> DataFrame:
    return lb.normalized_annotations(raw_reviews(spark, sf))


def resolved(spark, sf) -> DataFrame:
    tasks = review_tasks(spark, sf)
    clean = normalized(spark, sf).where((F.col("row_status") == "completed") & F.col("reject_reason").isNull())
    docs = labelled(spark, sf)
    asked = F.filter(
        F.array(
            F.lit("rev b"),
            F.when(F.col("lang") == "fr", F.lit("rev a")),
            F.when(F.col("source") == "src3", F.lit("rev e")),
        ),
        lambda r: r.isNotNull(),
    )
    expected = lb.expected_reviewers(docs.select("task_id", F.explode(asked).alias("reviewer_id")))
    judged = docs.where((F.col("toxic") == 1) & (F.col("lang") == "en")).select(
        "task_id",
        F.lit("judge").alias("adjudicator_id"),
        F.lit("no").alias("final_suspected_sepsis"),
        F.lit("").alias("final_suspicion_time"),
        F.lit("").alias("final_infection_source"),
        F.lit(" final ").alias("final_evidence_span"),
        F.lit("1").alias("final_confidence"),
        F.lit("2024-04-01T10:00:00").alias("adjudicated_at"),
    )
    final = lb.normalized_annotations(judged, prefix="final_", status=None, reviewed="adjudicated_at")
    return lb.resolved_labels(tasks, clean, expected, final)


def label_parsing(spark, sf):
    out = normalized(spark, sf)
    return out.select(
        "task_id", "reviewer_id", "row_status", "reject_reason", "suspected_sepsis", "suspicion_time",
        "infection_source", "evidence_span", "confidence", "reviewed_at",
    )


def label_load_counts(spark, sf):
    return lb.load_counts(normalized(spark, sf))


def label_consensus(spark, sf):
    out = lb.gold_labels(resolved(spark, sf), ["task_id", "lang", "n_chars"])
    return out.withColumn("supporting_reviewer_ids", F.array_join("supporting_reviewer_ids", "|"))


def resolution_index(spark, sf):
    return lb.resolution_index(resolved(spark, sf), ["task_id", "lang"])


def label_summary(spark, sf):
    return lb.label_summary(resolved(spark, sf))


def adjudication_pivot(spark, sf):
    return lb.adjudication_table(resolved(spark, sf), ["task_id"])


_SQL_REVIEWS = """
lab AS (SELECT 'doc-' || l.doc_id AS task_id, d.lang, d.source, d.n_chars, quality = 1 AS good, toxic,
  TIMESTAMP '2024-01-01' + to_microseconds(CAST(round(n_chars / 60.0 * 3600 * 1000000) AS BIGINT)) AS bt
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
x AS (SELECT *, strftime(bt, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN toxic = 1 THEN NOT good ELSE good END AS fl FROM lab),
n AS (
  SELECT task_id, 'rev b' AS reviewer_id, 'completed' AS row_status, CAST(NULL AS VARCHAR) AS reject_reason, good AS suspected_sepsis,
    CASE WHEN good THEN ts || '+00:00' END AS suspicion_time, CASE WHEN good THEN source END AS infection_source,
    lang || chr(10) || source AS evidence_span, 0.9 AS confidence, '2024-03-01 08:00:00' AS reviewed_at, lang, source, n_chars, toxic FROM x
  UNION ALL SELECT task_id, 'rev a', 'completed', NULL, fl, CASE WHEN fl THEN ts || '+00:00' END, CASE WHEN fl THEN upper(source) END,
    CASE WHEN lang = 'fr' THEN lang || ' ' || source ELSE 'see ' || source END, 0.6, NULL, lang, source, n_chars, toxic FROM x WHERE n_chars > 700
  UNION ALL SELECT task_id, 'rev c', CASE WHEN lang = 'de' THEN 'skipped' ELSE 'pending' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, lang, source, n_chars, toxic
    FROM x WHERE lang IN ('de', 'es')
  UNION ALL SELECT task_id, 'rev d', 'completed', 'unreadable_confidence', true, ts, NULL, source, NULL, '2024-03-01 08:00:00', lang, source, n_chars, toxic
    FROM x WHERE lang = 'es' AND n_chars > 3000)"""

_SQL_RESOLVED = _SQL_REVIEWS + """,
ok AS (SELECT * FROM n WHERE row_status = 'completed' AND reject_reason IS NULL),
agg AS (SELECT task_id, count(*) AS k, string_agg(reviewer_id, '|' ORDER BY reviewer_id) AS rids,
  count(DISTINCT concat_ws('/', suspected_sepsis, coalesce(suspicion_time, '~'), coalesce(lower(infection_source), '~'))) AS nc,
  count(DISTINCT concat_ws('/', suspected_sepsis, coalesce(suspicion_time, '~'), coalesce(lower(infection_source), '~'),
    lower(replace(evidence_span, chr(10), ' ')))) AS nf,
  round(avg(confidence), 6) AS mc, max(reviewed_at) AS lr,
  max(evidence_span) FILTER (reviewer_id = 'rev a') AS ea, max(evidence_span) FILTER (reviewer_id = 'rev b') AS eb FROM ok GROUP BY 1),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reviewer_id) rk FROM ok) WHERE rk = 1),
t AS (SELECT 'doc-' || d.doc_id AS task_id, d.lang, d.n_chars, x.task_id IS NOT NULL AS labelled, coalesce(k, 0) AS k, coalesce(rids, '') AS rids,
  nc, nf, mc, lr, ea, eb, f.suspected_sepsis AS fp, f.suspicion_time AS ft, f.infection_source AS fs, f.evidence_span AS fe, f.confidence AS fc,
  f.reviewer_id AS fr, f.reviewed_at AS fa,
  CASE WHEN x.task_id IS NULL THEN '' ELSE concat_ws('|', CASE WHEN x.lang = 'fr' THEN 'rev a' END, 'rev b', CASE WHEN x.source = 'src3' THEN 'rev e' END) END AS expd,
  coalesce(concat_ws('|', CASE WHEN x.lang = 'fr' AND rids NOT LIKE '%rev a%' THEN 'rev a' END, CASE WHEN x.source = 'src3' THEN 'rev e' END), '') AS miss,
  x.toxic = 1 AND x.lang = 'en' AS adj
  FROM documents d LEFT JOIN x ON x.task_id = 'doc-' || d.doc_id LEFT JOIN agg ON agg.task_id = x.task_id LEFT JOIN fst f ON f.task_id = x.task_id),
s AS (SELECT *, CASE WHEN adj THEN 'adjudicated' WHEN miss <> '' THEN 'awaiting_assigned_review' WHEN k = 0 THEN 'missing_annotation'
  WHEN k = 1 THEN 'single_review' WHEN nf = 1 THEN 'reviewer_agreement' WHEN nc = 1 THEN 'reviewer_core_agreement' ELSE 'needs_adjudication' END AS status FROM t)"""

_SQL_GOLD = "WITH" + _SQL_RESOLVED + """
SELECT task_id, lang, n_chars, status AS review_resolution,
  CASE WHEN status = 'adjudicated' THEN false ELSE fp END AS suspected_sepsis,
  CASE WHEN status <> 'adjudicated' THEN ft END AS suspicion_time,
  CASE WHEN status <> 'adjudicated' THEN fs END AS infection_source,
  CASE WHEN status = 'adjudicated' THEN 'final' WHEN status = 'single_review' THEN fe
    WHEN lower(ea) = lower(replace(eb, chr(10), ' ')) THEN ea ELSE ea || ' || ' || eb END AS evidence_span,
  CASE WHEN status = 'adjudicated' THEN 1.0 WHEN status = 'single_review' THEN fc ELSE mc END AS confidence,
  CASE WHEN status = 'adjudicated' THEN 'judge' WHEN status = 'single_review' THEN fr ELSE rids END AS final_reviewer_id,
  CASE WHEN status = 'adjudicated' THEN '2024-04-01 10:00:00' WHEN status = 'single_review' THEN fa ELSE lr END AS reviewed_at,
  CAST(CASE WHEN status = 'adjudicated' THEN k + 1 ELSE k END AS INTEGER) AS source_annotation_count,
  CASE WHEN status = 'adjudicated' THEN concat_ws('|', nullif(rids, ''), 'judge') ELSE rids END AS supporting_reviewer_ids
FROM s WHERE status IN ('adjudicated', 'single_review', 'reviewer_agreement', 'reviewer_core_agreement')"""

_SQL_INDEX = "WITH" + _SQL_RESOLVED + """
SELECT task_id, lang, status AS resolution_status, CAST(k AS INTEGER) AS completed_annotation_count, rids AS reviewer_ids,
  expd AS expected_reviewer_ids, CASE WHEN status = 'adjudicated' THEN '' ELSE miss END AS missing_expected_reviewers FROM s"""

_SQL_LABEL_SUMMARY = "WITH" + _SQL_RESOLVED + """,
c AS (SELECT count(*) AS n, count(*) FILTER (status = 'single_review') AS c1, count(*) FILTER (status = 'reviewer_agreement') AS c2,
  count(*) FILTER (status = 'reviewer_core_agreement') AS c3, count(*) FILTER (status = 'adjudicated') AS c4,
  count(*) FILTER (status = 'needs_adjudication') AS c5, count(*) FILTER (status = 'awaiting_assigned_review') AS c6,
  count(*) FILTER (status = 'missing_annotation') AS c7,
  CAST(sum(CASE WHEN status = 'awaiting_assigned_review' THEN length(miss) - length(replace(miss, '|', '')) + 1 ELSE 0 END) AS BIGINT) AS mr FROM s)
SELECT n AS task_count, c1 + c2 + c3 + c4 AS finalized_task_count, c5 + c6 + c7 AS blocking_task_count,
  c1 AS single_review_task_count, c2 AS reviewer_agreement_task_count, c3 AS reviewer_core_agreement_task_count,
  c4 AS adjudicated_task_count, c5 AS needs_adjudication_task_count, c6 AS awaiting_assigned_review_task_count,
  c7 AS missing_annotation_task_count, c2 + c3 + c5 AS double_review_task_count,
  round(c2 / nullif(c2 + c3 + c5, 0), 6) AS double_review_exact_agreement_rate,
  round((c2 + c3) / nullif(c2 + c3 + c5, 0), 6) AS double_review_core_agreement_rate, mr AS missing_assigned_review_count FROM c"""

_SQL_PIVOT = "WITH" + _SQL_RESOLVED + """
SELECT s.task_id, 'rev a' AS reviewer_1_id, CAST(a.suspected_sepsis AS VARCHAR) AS reviewer_1_suspected_sepsis,
  coalesce(a.suspicion_time, '') AS reviewer_1_suspicion_time, coalesce(a.infection_source, '') AS reviewer_1_infection_source,
  a.evidence_span AS reviewer_1_evidence_span, CAST(CAST(a.confidence AS DOUBLE) AS VARCHAR) AS reviewer_1_confidence, coalesce(a.reviewed_at, '') AS reviewer_1_reviewed_at,
  'rev b' AS reviewer_2_id, CAST(b.suspected_sepsis AS VARCHAR) AS reviewer_2_suspected_sepsis,
  coalesce(b.suspicion_time, '') AS reviewer_2_suspicion_time, coalesce(b.infection_source, '') AS reviewer_2_infection_source,
  b.evidence_span AS reviewer_2_evidence_span, CAST(CAST(b.confidence AS DOUBLE) AS VARCHAR) AS reviewer_2_confidence, coalesce(b.reviewed_at, '') AS reviewer_2_reviewed_at,
  '' AS final_suspected_sepsis, '' AS final_suspicion_time, '' AS final_infection_source, '' AS final_evidence_span,
  '' AS final_confidence, '' AS adjudicator_id, '' AS adjudicated_at, '' AS adjudication_notes
FROM s JOIN ok a ON a.task_id = s.task_id AND a.reviewer_id = 'rev a' JOIN ok b ON b.task_id = s.task_id AND b.reviewer_id = 'rev b'
WHERE status = 'needs_adjudication'"""


# ---------------------------------------------------------------------- value parsing


def time_parsing(spark, sf):
    """Event times in six spellings, normalised back."""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    kind = F.col("event_type")
    text = (
        F.when(kind == "signup", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:30")))
        .when(kind == "view", F.date_format("ts", "yyyy-M-d H:m"))
        .when(kind == "error", F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" ")))
        .otherwise(F.date_format("ts", "dd.MM.yyyy"))
    )
    return e.select(
        "event_id", time_text(lenient_time(text)).alias("parsed"), label_time_text(text).alias("label_text")
    )


_SQL_TIMES = """WITH p AS (SELECT event_id, event_type, CASE event_type
    WHEN 'signup' THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')
    WHEN 'click' THEN strftime(date_trunc('second', ts) - INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M:%S')
    WHEN 'view' THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')
    WHEN 'error' THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events)
SELECT event_id, parsed, CASE WHEN event_type IN ('signup', 'click') THEN parsed || '+00:00' ELSE parsed END AS label_text FROM p"""


def value_parsing(spark, sf):
    """Human booleans, confidences, comparison forms and evidence lines from order fields."""
    o = table(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    word = F.when(status == "F", " Yes ").when(status == "O", "f").otherwise("maybe")
    number = (F.col("o_totalprice") / 333333).cast("string")
    spans = F.concat(F.lit("  "), priority, F.lit(" \r\n  of "), status, F.lit("\n"))
    return o.select(
        "o_orderkey",
        lenient_bool(word).alias("flag"),
        F.round(confidence(number), 6).alias("confidence"),
        signature(F.concat(F.lit("\t"), priority, F.lit("   of\n"), status)).alias("signature"),
        evidence_lines(spans).alias("evidence"),
    )


_SQL_VALUES = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag,
  CASE WHEN o_totalprice / 333333 BETWEEN 0 AND 1 THEN round(o_totalprice / 333333, 6) END AS confidence,
  lower(o_orderpriority || ' of ' || o_orderstatus) AS signature,
  o_orderpriority || chr(10) || 'of ' || o_orderstatus AS evidence FROM orders"""

QUERIES = {
    "evaluate_predictors": Bound(evaluate_predictors, _SQL_EVALUATE),
    "pairwise_disagreement": Bound(pairwise_disagreement, _SQL_PAIRWISE),
    "material_disagreement": Bound(material_disagreement, _SQL_MATERIAL),
    "predictor_stack": Bound(predictor_stack, _SQL_STACK),
    "reviewer_assignment": Bound(
        reviewer_assignment, "WITH" + _SQL_ASSIGN + " SELECT task_id, reviewer_id, assignment_role FROM a"
    ),
    "assignment_counts": Bound(
        assignment_counts,
        "WITH" + _SQL_ASSIGN + """ SELECT reviewer_id, count(*) AS assignment_count,
  count(*) FILTER (assignment_role = 'secondary') AS secondary_count FROM a GROUP BY 1""",
    ),
    "reviewer_packets": Bound(
        reviewer_packets,
        "WITH" + _SQL_ASSIGN + """ SELECT reviewer_id, assignment_role, 'pending' AS annotation_status, count(*) AS tasks,
  CAST(sum(n_chars) AS BIGINT) AS n_chars, '' AS filled FROM a GROUP BY 1, 2""",
    ),
    "label_parsing": Bound(
        label_parsing,
        "WITH" + _SQL_REVIEWS + """ SELECT task_id, reviewer_id, row_status, reject_reason, suspected_sepsis, suspicion_time,
  infection_source, evidence_span, CAST(confidence AS DOUBLE) AS confidence, reviewed_at FROM n""",
    ),
    "label_load_counts": Bound(
        label_load_counts,
        "WITH" + _SQL_REVIEWS + """ SELECT count(*) FILTER (row_status = 'completed') AS completed_count,
  count(*) FILTER (row_status = 'pending') AS pending_count, count(*) FILTER (row_status = 'skipped') AS skipped_count,
  count(reject_reason) AS rejected_count FROM n""",
    ),
    "label_consensus": Bound(label_consensus, _SQL_GOLD),
    "resolution_index": Bound(resolution_index, _SQL_INDEX),
    "label_summary": Bound(label_summary, _SQL_LABEL_SUMMARY),
    "adjudication_pivot": Bound(adjudication_pivot, _SQL_PIVOT),
    "time_parsing": Bound(time_parsing, _SQL_TIMES),
    "value_parsing": Bound(value_parsing, _SQL_VALUES),
}
