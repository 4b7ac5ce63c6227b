SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), rep AS (
  SELECT r, i FROM win JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) USING (r, g)
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, 5)) AS k FROM rep) GROUP BY r
), lines AS (
  SELECT r, doc_id, source, text,
         translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM (SELECT r, doc_id, source, text, unnest(l) AS x FROM w)
), freq AS (
  SELECT source, line, min(doc_id) AS first_doc FROM lines GROUP BY source, line HAVING count(DISTINCT (doc_id, text)) > 20
), lost AS (
  SELECT r, sum(length(lines.line)) AS chars, count(*) AS n
  FROM lines JOIN freq ON lines.line = freq.line AND lines.source IS NOT DISTINCT FROM freq.source
  WHERE NOT coalesce(doc_id = first_doc, false) GROUP BY r
), total AS (
  SELECT r, sum(length(line)) AS chars FROM lines GROUP BY r
), c AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS removed_lines,
         100 * coalesce(lost.chars, 0) > 50 * coalesce(total.chars, 0) AS depleted
  FROM w LEFT JOIN cover ON w.r = cover.r LEFT JOIN lost ON w.r = lost.r LEFT JOIN total ON w.r = total.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, removed_lines, depleted,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT depleted AS kept
FROM c
"""
