"""Queries of the operators here, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from strandweave.llm.gif import op9_gif_media
from strandweave.llm.jaccard import op2_jaccard_join
from strandweave.llm.katz import op3_katz_scoring
from strandweave.llm.language import op4_language_id
from strandweave.llm.mergedrop import op5_merge_dropout
from strandweave.llm.packing import op1_best_fit_packing
from strandweave.llm.quality import HOST_LIMIT, op7_quality_rules
from strandweave.llm.substrings import op6_substring_dedup
from strandweave.llm.tokencount import op8_token_counts
from strandweave.llm.warc import op10_warc

_WORD = r"'[^\x20\x09-\x0D]+'"

OP2_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), sized AS (SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(list_sort(s), chr(10))) AS h, s FROM sets),
reps AS (SELECT min(doc_id) AS rep, h, any_value(n) AS n, any_value(s) AS s FROM sized WHERE n > 0 GROUP BY h),
items AS (SELECT rep, n, unnest(s) AS g FROM reps),
common AS (
  SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2
), links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON r.b = l.x),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, CASE WHEN d.n = 0 THEN d.doc_id ELSE c.m END AS component_id
FROM sized d LEFT JOIN reps r ON d.h = r.h AND d.n > 0 LEFT JOIN comp c ON c.a = r.rep
"""

OP6_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
listed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(ps, p)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN listed USING (doc_id)
"""

OP7_SQL = rf"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
lines AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3))
), repeats AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT greatest(least(avg(f / n), 1 - 1e-6), 1e-6) AS m, var_samp(f / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (n + s) > {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM judged
"""


def queries() -> dict:
    named = (
        op1_best_fit_packing, op2_jaccard_join, op3_katz_scoring, op4_language_id, op5_merge_dropout,
        op6_substring_dedup, op7_quality_rules, op8_token_counts, op9_gif_media, op10_warc,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL}
