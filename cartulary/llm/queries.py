"""The operators' queries: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from . import byte_bpe, edit_counts, licenses, near_dedup, neighbours, packing, quality, secrets, suffix_tree, token_files

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_license_scans": licenses.op2,
    "op3_byte_bpe_monoid": byte_bpe.op3,
    "op4_token_files": token_files.op4,
    "op5_edit_counts": edit_counts.op5,
    "op6_near_dedup": near_dedup.op6,
    "op7_suffix_tree_scores": suffix_tree.op7,
    "op8_secret_scans": secrets.op8,
    "op9_learned_partitions": neighbours.op9,
    "op10_best_fit_packing": packing.op10,
    "base_quality_counts": lambda spark, d: quality.op1(spark, d).select("doc_id", *quality.BASE, "base_failed"),
    "base_license_places": lambda spark, d: licenses.op2(spark, d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "base_secret_counts": lambda spark, d: secrets.op8(spark, d).select("doc_id", "n_assign", "n_access", "n_hex"),
}
#: SQL has neither the vocabularies nor trained models; those queries are tested against brute force.  What it can say of
#: operators 1, 2 and 8, their base columns, are queries of their own: the same operators over the same whole tables.
ORACLE_SQL: dict[str, str] = {
    "base_quality_counts": r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts
), runs AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1
), covered AS (
  SELECT doc_id, CAST(COUNT(DISTINCT i + k) AS BIGINT) AS n FROM again CROSS JOIN (VALUES (0), (1), (2), (3), (4)) s(k) GROUP BY 1
), dups AS (
  SELECT doc_id, CAST(COUNT(*) - COUNT(DISTINCT line) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM cut
)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(c.n, 0) > 20 * n_words AS base_failed
FROM counts LEFT JOIN dups d USING (doc_id) LEFT JOIN covered c USING (doc_id)""",
    "base_license_places": r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(label, words) AS (
  VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])
), places AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM cut) JOIN phrases ON w[i] = words[1] AND w[i : i + len(words) - 1] = words
)
SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_base, p.first_word, p.last_word, coalesce(p.labels, '') AS base_labels
FROM cut c LEFT JOIN (SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n, MIN(place) AS first_word, MAX(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1) p ON p.doc_id = c.doc_id""",
    "base_secret_counts": r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM documents""",
    "op6_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [0] ELSE [] END) AS i FROM words
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN i = 0 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s FROM places
), sizes AS (
  SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reached AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM reached r JOIN links l ON r.doc_id = l.x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, MIN(c) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""",
}
