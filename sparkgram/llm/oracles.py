"""DuckDB twins of the queries that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS w FROM sums
), levels AS (
  SELECT *, 2 * source_size AS cap,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(w) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), drawn AS (
  SELECT doc_id, size, source_size, target, rate,
    ('0x' || substr(md5(concat_ws(':', 'mix-1', doc_id::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM drawn
"""
