"""The operators bound to the given tables, one query each, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.bindings import Bound
from stayline.llm import (
    bottom_k, byte_bpe, fertility, fp_search, html_content, line_index, ordinal_quality, packing, piece_counts,
    record_files, rotation_codes, spelling, warc,
)
from stayline.llm.common import table


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of the given labels: 0 toxic, 1 poor, 2 good; unknown ones left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade IS NOT NULL")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, sf, "documents"))


def encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.encoding_digests(table(spark, sf, "documents"))


def embedding_links(spark: SparkSession, sf: str) -> DataFrame:
    return rotation_codes.near_duplicates(table(spark, sf, "embeddings"))


def quality_grades(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = ordinal_quality.fit(docs, grades(table(spark, sf, "labels")))
    return ordinal_quality.scored(docs.select("doc_id", "text"), model).drop("text")


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_content.extracted(table(spark, sf, "pages"))


def near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf, "documents"), shingle=3, percent=85)


def page_archives(spark: SparkSession, sf: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf, "documents"))


def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return fertility.judged(table(spark, sf, "documents")).drop("band")


def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kept = line_index.without_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def benchmark_search(spark: SparkSession, sf: str) -> DataFrame:
    return fp_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"))


def token_records(spark: SparkSession, sf: str) -> DataFrame:
    manifest = record_files.write_records(table(spark, sf, "documents"))
    return record_files.read_records(manifest)


_SEARCH_SQL = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
size AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
tf AS (SELECT doc_id, t, count(*) AS tf FROM found WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
measure AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM size, total),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN measure USING (doc_id) GROUP BY item_id, doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM placed WHERE place <= 10"""

_LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, pos, part, regexp_replace(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
firsts AS (SELECT k, min(doc_id) AS keeper FROM line WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper < l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper >= l.doc_id), '')) AS kept_sha256
FROM line l LEFT JOIN firsts USING (k) GROUP BY l.doc_id"""

_LINKS_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE label IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (
  SELECT vec_id AS node, vec_id AS start FROM embeddings UNION SELECT b, start FROM reached JOIN link ON node = a),
component AS (SELECT node, min(start) AS component_id FROM reached GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON vec_id = node LEFT JOIN degree ON vec_id = a"""

_COPIES_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM word)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reached AS (
  SELECT doc_id AS node, doc_id AS start FROM documents UNION SELECT b, start FROM reached JOIN either ON node = a),
component AS (SELECT node, min(start) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component ON d.doc_id = node LEFT JOIN size ON size.doc_id = d.doc_id"""

_ARCHIVES_SQL = """
WITH payload AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
part AS (SELECT *, [('0x' || substr(hex, 1 + 5 * i, 5))::INTEGER for i in range(0, 8)] AS parts FROM payload)
SELECT page_id, octet_length(body) AS payload_bytes, list_aggregate([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)
    for v in parts], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM part"""

QUERIES: dict[str, Bound] = {
    "op1_token_counts": Bound(token_counts),
    "op2_encode_decode": Bound(encode_decode),
    "op3_embedding_links": Bound(embedding_links, _LINKS_SQL),
    "op4_quality_grades": Bound(quality_grades),
    "op5_page_text": Bound(page_text),
    "op6_near_copies": Bound(near_copies, _COPIES_SQL),
    "op7_page_archives": Bound(page_archives, _ARCHIVES_SQL),
    "op8_sequences": Bound(sequences),
    "op9_quality_rules": Bound(quality_rules),
    "op10_repeated_lines": Bound(repeated_lines, _LINES_SQL),
    "op11_benchmark_search": Bound(benchmark_search, _SEARCH_SQL),
    "op12_spelling_variants": Bound(spelling_variants),
    "op13_token_records": Bound(token_records),
}
