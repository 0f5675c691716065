"""Note, bundle, classifier and extraction bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.bindings import Bound, table, with_micros
from stayline.bindings.timelines import sql_users, user_cohort
from stayline.functions.text import lowered, matches
from stayline.functions.times import add_hours
from stayline.operators import extraction as ex, notes as nt
from stayline.operators.phrases import with_labels
from stayline.operators.scale import spread
from stayline.plans import fixed_values as fv

_T = "%Y-%m-%d %H:%M:%S.%f"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_case(text: str, rules) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({text}, {_sql_text(p)}) THEN {_sql_text(label)}" for label, p in rules
    ) + " END"


def text_source_classifier(spark, sf):
    """The study's text rules over whole documents."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    found = with_labels(
        docs, lowered(F.col("text")),
        labels={
            "phrase": fv.NOTE_PHRASES, "context_source": fv.CONTEXT_SOURCES, "diagnosis_source": fv.DIAGNOSIS_SOURCES,
            "pattern": (("an", r"\bthe [a-z]+ an\b"), ("on", r"tion(ier)?\b"), ("re", r"re{1,2}")),
        },
        flags={"drug": fv.ANTIBIOTIC_PATTERN, "topical": fv.TOPICAL_DRUG_PATTERN, "word": r"\bas\b|\ble\b"},
    )
    local = matches(lowered(F.col("source")), fv.NON_SYSTEMIC_ROUTE_PATTERN)
    return found.select(
        "doc_id", "phrase", "context_source", "diagnosis_source",
        (F.col("drug") & ~F.col("topical") & ~local).alias("antibiotic"), "word", "pattern",
    )


_SQL_CLASSIFY = f"""SELECT doc_id, {_sql_case('lower(text)', fv.NOTE_PHRASES)} AS phrase,
  {_sql_case('lower(text)', fv.CONTEXT_SOURCES)} AS context_source,
  {_sql_case('lower(text)', fv.DIAGNOSIS_SOURCES)} AS diagnosis_source,
  regexp_matches(lower(text), {_sql_text(fv.ANTIBIOTIC_PATTERN)}) AND NOT regexp_matches(lower(text), {_sql_text(fv.TOPICAL_DRUG_PATTERN)})
    AND NOT regexp_matches(lower(source), {_sql_text(fv.NON_SYSTEMIC_ROUTE_PATTERN)}) AS antibiotic,
  regexp_matches(lower(text), '\\bas\\b|\\ble\\b') AS word,
  CASE WHEN regexp_matches(lower(text), '\\bthe [a-z]+ an\\b') THEN 'an' WHEN regexp_matches(lower(text), 'tion(ier)?\\b') THEN 'on'
    WHEN regexp_matches(lower(text), 're{{1,2}}') THEN 're' END AS pattern FROM documents"""


# ------------------------------------------------------------------------ linked notes


def document_notes(spark, sf) -> DataFrame:
    """Documents as notes of users, dealt over all of them; the character count places them
    in time."""
    users = table(spark, sf, "events").agg(F.max("user_id") + 1).scalar()
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    charted = add_hours(start, F.pmod("n_chars", F.lit(720)).cast("double"))
    return table(spark, sf, "documents").select(
        F.pmod("doc_id", users).alias("subject_id"),
        F.pmod("doc_id", users).alias("hadm_id"),
        F.col("doc_id").cast("string").alias("note_id"),
        charted.alias("charttime"),
        F.when(F.col("lang") != "de", add_hours(charted, 1)).alias("storetime"),
        "text",
    )


def linked_notes(spark, sf):
    """Both note domains: windowed and unwindowed, next to the stay."""
    cohort = user_cohort(spark, sf, 48, 240)
    notes = document_notes(spark, sf)
    out = []
    for domain, windowed, *_ in fv.NOTE_DOMAINS:
        linked = nt.linked_notes(cohort, notes, windowed=windowed)
        joined = nt.with_cohort_columns(cohort.select("stay_id", "subject_id"), linked)
        out.append(joined.withColumn("domain", F.lit(domain)))
    both = out[0].unionByName(out[1]).select(
        "domain", "stay_id", "subject_id", "note_id", "note_charttime", "note_storetime",
        F.length("text").alias("chars"), F.md5("text").alias("text_md5"),
    )
    return with_micros(both, "note_charttime", "note_storetime")


_SQL_LINKED = "WITH" + sql_users(48, 240) + f""",
n AS (SELECT doc_id % (SELECT max(user_id) + 1 FROM events) AS user_id, CAST(doc_id AS VARCHAR) AS note_id, lang, text,
  TIMESTAMP '2024-01-01' + to_hours(CAST(n_chars % 720 AS BIGINT)) AS ct FROM documents),
l AS (SELECT u.stay_id, u.subject_id, n.*, ct BETWEEN ws AND we AS inside FROM users u JOIN n ON n.user_id = u.subject_id)
SELECT d.domain, stay_id, subject_id, note_id, strftime(ct, '{_T}') AS note_charttime,
  CASE WHEN lang <> 'de' THEN strftime(ct + INTERVAL 1 HOUR, '{_T}') END AS note_storetime,
  CAST(length(text) AS INTEGER) AS chars, md5(text) AS text_md5
FROM l JOIN (VALUES ('radiology'), ('discharge')) d(domain) ON d.domain = 'discharge' OR inside"""


# ------------------------------------------------------------------------------ bundles


def conversation_notes(spark, sf) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    charted = F.when(F.col("turn") < 5, add_hours(start, F.col("turn").cast("double")))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("stay_id"),
        F.col("conv_id").alias("subject_id"),
        F.col("conv_id").alias("hadm_id"),
        F.concat_ws("-", F.col("turn").cast("string"), "role").alias("note_id"),
        charted.alias("note_charttime"),
        "text",
    )


BUDGET = {"max_notes": 4, "max_chars": 1500}


def budgeted_topk(spark, sf):
    kept = nt.budgeted_notes(conversation_notes(spark, sf), **BUDGET)
    return kept.select("stay_id", "note_id", "note_char_count", "note_rank", "running_char_count")


_SQL_BUDGET = """
n AS (SELECT conv_id AS stay_id, turn || '-' || role AS note_id, text, length(text) AS c,
  CASE WHEN turn < 5 THEN TIMESTAMP '2024-01-01' + to_hours(turn) END AS ct FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS rk, CAST(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run
  FROM n WINDOW w AS (PARTITION BY stay_id ORDER BY ct NULLS LAST, note_id)),
k AS (SELECT * FROM r WHERE rk <= 4 AND run <= 1500)"""


def note_bundle(spark, sf):
    tasks = nt.note_bundles(nt.budgeted_notes(conversation_notes(spark, sf), **BUDGET))
    rendered = nt.rendered_notes(F.col("notes"))
    prompt = nt.prompt_column(
        "task {task_id} subject {subject_id} has {note_count} notes\n{rendered_notes}\n",
        {
            "task_id": F.col("task_id"), "subject_id": F.col("subject_id"),
            "note_count": F.col("note_count"), "rendered_notes": rendered,
        },
    )
    return tasks.select(
        "task_id", "stay_id", "note_count", "first_note_time", "last_note_time", "annotation_status",
        F.length(prompt).alias("prompt_chars"), F.md5(prompt).alias("prompt_md5"),
    )


_SQL_BUNDLE = "WITH" + _SQL_BUDGET + r""",
b AS (SELECT stay_id, count(*) AS n, min_by(coalesce(strftime(ct, '%Y-%m-%d %H:%M:%S'), '~'), rk) AS f,
  max_by(coalesce(strftime(ct, '%Y-%m-%d %H:%M:%S'), '~'), rk) AS l,
  string_agg('[Note ' || rk || ']' || chr(10) || 'note_id: ' || note_id || chr(10) || 'charttime: '
    || coalesce(strftime(ct, '%Y-%m-%d %H:%M:%S'), 'unknown') || chr(10) || 'text:' || chr(10)
    || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10) || chr(10) ORDER BY rk) AS t FROM k GROUP BY 1),
p AS (SELECT *, 'task stay-' || stay_id || ' subject ' || stay_id || ' has ' || n || ' notes' || chr(10) || t || chr(10) AS prompt FROM b)
SELECT 'stay-' || stay_id AS task_id, stay_id, CAST(n AS INTEGER) AS note_count, nullif(f, '~') AS first_note_time,
  nullif(l, '~') AS last_note_time, 'pending' AS annotation_status, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM p"""


# --------------------------------------------------------------------------- extraction


def model_answers(spark, sf) -> DataFrame:
    """Model answers in the shapes models give: prose, broken braces, several objects."""
    e = table(spark, sf, "events")
    kind, v = F.col("event_type"), F.col("value")
    stamp = F.when(v < 5, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    score = F.when(v > 100, "1.5").otherwise("0.8765432")
    positive = F.concat(
        F.lit('Sure {not json} {"suspected_sepsis": "Yes", "suspicion_time": "'), stamp,
        F.lit('", "infection_source": " lung ", "evidence_span": "k", "confidence": '), score,
        F.lit('} then {"a": 1}'),
    )
    empty = F.lit(
        '```json\n{"suspected_sepsis": true, "suspicion_time": null, "infection_source": "x", '
        '"evidence_span": "y", "confidence": 0.5}\n```'
    )
    negative = F.concat(
        F.lit('{"suspected_sepsis": 0, "suspicion_time": "2024-01-01", "infection_source": "x", "evidence_span": '),
        F.col("props"), F.lit(', "confidence": "0.25"}'),
    )
    text = (
        F.when(kind == "signup", F.concat(F.lit("no answer { for k"), F.col("event_id").cast("string")))
        .when(kind == "click", F.concat(F.lit("Answer: "), F.col("props")))
        .when(kind == "purchase", positive)
        .when(kind == "view", empty)
        .otherwise(negative)
    )
    return e.select(
        "event_id",
        F.when(F.col("user_id") < 50, "model_1").otherwise("model_2").alias("model_slot"),
        F.when(F.col("user_id") < 50, "m-1").otherwise("m-2").alias("model_id"),
        (v / 10).alias("latency_seconds"),
        text.alias("raw_response_text"),
    )


def extraction_parse(spark, sf):
    out = ex.parsed_answers(model_answers(spark, sf))
    return out.select("event_id", "extraction_status", "error_kind", "normalized_extraction.*")


_SQL_STATUS = """
s AS (SELECT *, CASE event_type WHEN 'signup' THEN 'no_json_object' WHEN 'click' THEN 'missing_keys'
  WHEN 'purchase' THEN CASE WHEN value < 5 THEN 'unreadable_time' WHEN value > 100 THEN 'unreadable_confidence' END
  WHEN 'view' THEN 'positive_without_details' END AS kind FROM events),
q AS (SELECT *, CASE WHEN kind IS NULL THEN 'ok' WHEN kind = 'no_json_object' THEN 'parse_error'
  WHEN kind IN ('missing_keys', 'positive_without_details') THEN 'schema_error' ELSE 'request_error' END AS st FROM s)"""

_SQL_EXTRACT = "WITH" + _SQL_STATUS + """
SELECT event_id, st AS extraction_status, kind AS error_kind, CASE WHEN st = 'ok' THEN event_type = 'purchase' END AS suspected_sepsis,
  CASE WHEN st = 'ok' AND event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' END AS suspicion_time,
  CASE WHEN st = 'ok' AND event_type = 'purchase' THEN 'lung' END AS infection_source,
  CASE WHEN st = 'ok' AND event_type = 'purchase' THEN 'k' END AS evidence_span,
  CASE WHEN st = 'ok' THEN CAST(CASE WHEN event_type = 'purchase' THEN 0.876543 ELSE 0.25 END AS DOUBLE) END AS confidence FROM q"""


def extraction_summary(spark, sf):
    return ex.extraction_summary(ex.parsed_answers(model_answers(spark, sf)))


_SQL_EXTRACT_SUMMARY = "WITH" + _SQL_STATUS + """
SELECT CASE WHEN user_id < 50 THEN 'model_1' ELSE 'model_2' END AS model_slot, CASE WHEN user_id < 50 THEN 'm-1' ELSE 'm-2' END AS model_id,
  count(*) AS result_count, count(*) FILTER (st = 'ok') AS ok_count, count(*) FILTER (st <> 'ok') AS error_count,
  round(avg(value / 10), 6) AS average_latency_seconds FROM q GROUP BY 1, 2"""

QUERIES = {
    "text_source_classifier": Bound(text_source_classifier, _SQL_CLASSIFY),
    "linked_notes": Bound(linked_notes, _SQL_LINKED),
    "budgeted_topk": Bound(
        budgeted_topk,
        "WITH" + _SQL_BUDGET + """ SELECT stay_id, note_id, CAST(c AS INTEGER) AS note_char_count, CAST(rk AS INTEGER) AS note_rank,
  run AS running_char_count FROM k""",
    ),
    "note_bundle": Bound(note_bundle, _SQL_BUNDLE),
    "extraction_parse": Bound(extraction_parse, _SQL_EXTRACT),
    "extraction_summary": Bound(extraction_summary, _SQL_EXTRACT_SUMMARY),
}
