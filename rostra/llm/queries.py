"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import exact_dedup, language_id, license_scan, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules
from ._shared import documents


def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_packing(spark, sf_dir):
    return packing.packing(documents(spark, sf_dir))


def op3_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.quality_scores(documents(spark, sf_dir).select("doc_id", "text"), labels).select("body.doc_id", "held_out", "score", "predicted")


def op7_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_language_id(spark, sf_dir):
    return language_id.language_id(documents(spark, sf_dir))


def op10_license_scan(spark, sf_dir):
    return license_scan.license_scan(documents(spark, sf_dir))


_WS = r"[\x20\x09-\x0D]"
_NOT = r"[^\x20\x09-\x0D]"

OP1 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP3 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_NOT}+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '-')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(0.05, 1.0 - 4.0 * (greatest(length(text), 1) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g'))) / greatest(length(text), 1)) AS k
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM sized GROUP BY source),
caps AS (SELECT source, source_size, CASE r WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM ranked),
run AS (
  SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER before, 0)::BIGINT AS rest, sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT AS rw
  FROM caps WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT rest, rw FROM run WHERE cap * rw >= w * rest ORDER BY cap / w, source NULLS LAST LIMIT 1),
goal AS (
  SELECT source, source_size, least(cap::DOUBLE, (w * lvl.rest)::DOUBLE / lvl.rw) AS target FROM run, lvl),
plan AS (SELECT *, floor(target / source_size)::BIGINT AS e FROM goal),
cum AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.e, floor(p.target - p.e * p.source_size + 0.5)::BIGINT AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, e * size + greatest(0, least(size, rest - (upto - size))) AS taken FROM cum"""

OP5 = rf"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)"""

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NOT}+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r(x, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.c = e.x)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_NOT}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_NOT}')) AS full_lines, string_split(text, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
    length(regexp_replace(text, '[^A-Za-zÀ-ɏ]+', '', 'g')) AS n_latin, length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters, len(lines) AS n_lines, len(full_lines) AS n_full,
    len(list_filter(lines, lambda x: regexp_matches(x, '^{_WS}*[-*•]'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){_WS}*$'))) AS n_ellipses
  FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.25 AND (2 * n_latin < n_letters OR n_stop / n_words >= 0.02)
    AND n_dup_lines / greatest(n_full, 1) <= 0.5 AND n_bullets / n_lines <= 0.9 AND n_ellipses / n_lines <= 0.5 AS kept
FROM v"""


def queries():
    return {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_mixing, op4_lm_scoring, op5_exact_dedup, op6_quality_classifier, op7_ngram_join, op8_quality_rules, op9_language_id, op10_license_scan)}


def oracle_sql():
    return {"op1_line_dedup": OP1, "op3_mixing": OP3, "op5_exact_dedup": OP5, "op7_ngram_join": OP7, "op8_quality_rules": OP8}
