SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('7:' || coalesce(doc_id::VARCHAR, '-')), 1, 16) AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, place % 3 + 1 AS weight, [0.0, 0.5, -0.5][place % 3 + 1]::DOUBLE AS slope, 3 * source_size AS cap FROM s
), f AS (
  SELECT *, row_number() OVER o AS rank,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, place)
), c AS (
  SELECT *, cap * rest_weight <= rest * weight AS capped FROM f
), t AS (
  SELECT source, source_size, slope,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE (weight * (SELECT arg_min(rest, rank) FROM c WHERE NOT capped))::DOUBLE / (SELECT arg_min(rest_weight, rank) FROM c WHERE NOT capped)::DOUBLE END AS target
  FROM c
), p AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d
), q AS (
  SELECT doc_id, size, source_size, target, slope, start,
         (start < target)::BIGINT + (start + source_size < target)::BIGINT + (start + 2 * source_size < target)::BIGINT AS copies, start / target AS share
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN share
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END, 6) END AS position
FROM q
"""
